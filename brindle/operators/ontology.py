"""Entities, labels, hierarchy and text views of an ontology given as triples.

triples(s, p, o, o_kind): o_kind is uri, literal or other. edges(child, parent). Everything is joins
and aggregations; the depth of walks is a parameter, so plans have a fixed size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.normal import normal_form
from brindle.functions.text import iri_label, local_name, squeeze, tag_role
from brindle.sources.materialize import materialize

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS, OWL, SKOS, OBO = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#", "http://www.geneontology.org/formats/oboInOwl#"
SUBCLASS, SUBPROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
# Label properties in order of precedence.
LABEL_PROPERTIES = [RDFS + "label", SKOS + "prefLabel", SKOS + "altLabel", OBO + "hasExactSynonym", OBO + "hasRelatedSynonym", OBO + "hasSynonym"]
PROPERTY_TYPES = [OWL + "ObjectProperty", OWL + "DatatypeProperty", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"]
# Ends of the names of properties that hold definitions and further synonyms.
DEFINITION_ENDS, SYNONYM_ENDS = ("iao_0000115", "definition", "description", "scopenote", "p97"), ("p90", "p108")

#: Children of one parent in a list, or 1/FAMILIES of all links where that is more; pairs of siblings that one task makes.
FAMILY, FAMILIES, TASK_PAIRS = 2000, 200_000, 10_000_000


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ends(triples: DataFrame, predicate: str) -> DataFrame:
    t = triples.filter((F.col("p") == predicate) & (F.col("o_kind") == "uri"))
    return t.select(F.col("s").alias("iri")).unionByName(t.select(F.col("o").alias("iri")))


def entities(triples: DataFrame, mode: str = "classes") -> DataFrame:
    """(iri, entity_type): named classes and both ends of subclass links; with `classes_and_properties` also
    properties and both ends of subproperty links that are no class. Nodes without a name are left out."""
    typed = lambda kinds: triples.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(kinds)).select(F.col("s").alias("iri"))
    named = F.col("iri").isNotNull() & ~F.col("iri").startswith("_:")
    classes = typed([OWL + "Class"]).unionByName(_ends(triples, SUBCLASS)).filter(named).distinct()
    out = classes.withColumn("entity_type", F.lit("class"))
    if mode == "classes_and_properties":
        props = typed(PROPERTY_TYPES).unionByName(_ends(triples, SUBPROPERTY)).filter(named).distinct()
        out = out.unionByName(props.join(classes, "iri", "left_anti").withColumn("entity_type", F.lit("property")))
    elif mode != "classes":
        raise ValueError(f"unknown mode {mode}")
    return out


def labels(ents: DataFrame, triples: DataFrame) -> DataFrame:
    """`ents` with label, synonyms and all_labels: literals of the label properties by precedence, then text,
    equal ones once; without any the identifier's readable last part."""
    rank = F.create_map(*[x for k, p in enumerate(LABEL_PROPERTIES) for x in (F.lit(p), F.lit(k))])
    lit = triples.filter(F.col("p").isin(LABEL_PROPERTIES) & (F.col("o_kind") == "literal") & F.col("o").isNotNull())
    lit = lit.groupBy(F.col("s").alias("iri"), "o").agg(F.min(rank[F.col("p")]).alias("k"))
    lists = lit.groupBy("iri").agg(F.array_sort(F.collect_list(F.struct("k", "o"))).alias("x")).select("iri", F.transform("x", lambda v: v["o"]).alias("all_labels"))
    out = ents.join(lists, "iri", "left").withColumn("all_labels", F.coalesce("all_labels", F.array(iri_label(F.col("iri")))))
    return out.withColumn("label", F.element_at("all_labels", 1)).withColumn("synonyms", F.slice("all_labels", 2, F.greatest(F.size("all_labels") - 1, F.lit(0))))


def hierarchy(triples: DataFrame, ents: DataFrame) -> DataFrame:
    """(child, parent): distinct subclass and subproperty links whose ends are both known, without loops."""
    e = triples.filter(F.col("p").isin(SUBCLASS, SUBPROPERTY) & (F.col("o_kind") == "uri")).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    known = ents.select("iri")
    e = e.join(known.withColumnRenamed("iri", "child"), "child", "left_semi").join(known.withColumnRenamed("iri", "parent"), "parent", "left_semi")
    return e.filter("child <> parent").distinct()


def lookup(ents: DataFrame, keys: DataFrame, key: str = "iri") -> DataFrame:
    """Records of the given identifiers; unknown ones are left out."""
    return ents.join(keys.select(F.col(key).alias("iri")).distinct(), "iri", "left_semi")


def with_counts(ents: DataFrame, edges: DataFrame) -> DataFrame:
    """`ents` with n_synonyms, n_parents and n_children."""
    up = edges.groupBy(F.col("child").alias("iri")).agg(F.count(F.lit(1)).alias("n_parents"))
    down = edges.groupBy(F.col("parent").alias("iri")).agg(F.count(F.lit(1)).alias("n_children"))
    out = ents.join(up, "iri", "left").join(down, "iri", "left").na.fill(0, ["n_parents", "n_children"])
    return out.withColumn("n_synonyms", F.size("synonyms")) if "synonyms" in ents.columns else out


def layers(edges: DataFrame, direction: str = "up", depth: int = 4) -> DataFrame:
    """(iri, node, depth): every node within `depth` steps, in its first layer only, the start left out; safe with cycles."""
    one = ("child", "parent") if direction == "up" else ("parent", "child")
    step = edges.select(F.col(one[0]).alias("x"), F.col(one[1]).alias("y")).filter("x <> y").distinct()
    step = materialize(step, "links")
    front = step.select(F.col("x").alias("iri"), F.col("y").alias("node"))
    out = front.withColumn("depth", F.lit(1))
    for k in range(2, depth + 1):
        front = front.join(step, front.node == step.x).select("iri", F.col("y").alias("node")).filter("iri <> node").distinct()
        # written, since the next layer and all later ones read it
        front = materialize(front.join(out.select("iri", "node"), ["iri", "node"], "left_anti"), "layer")
        out = out.unionByName(front.withColumn("depth", F.lit(k)))
    return out


def ancestors(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(iri, node) over all layers upwards."""
    return layers(edges, "up", depth).select("iri", "node")


def _links(edges: DataFrame) -> DataFrame:
    """(child, parent, n): distinct links whose ends are both known, with the number of the child's parents; written."""
    e = materialize(edges.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct(), "links")
    several = e.groupBy("child").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return materialize(e.join(several, "child", "left").na.fill(1, ["n"]), "links")


def siblings(edges: DataFrame) -> DataFrame:
    """(iri, node): other children of a parent. A parent's children are dealt into lists, each two lists meet in one row and
    give its pairs where they meet. Only a pair of which both have several parents can be met twice; only those are shuffled."""
    links = _links(edges)
    sizes = materialize(links.groupBy("parent").agg(F.count(F.lit(1)).alias("k")), "families")
    total, n_pairs = sizes.agg(F.sum("k"), F.sum(F.col("k").cast("double") * F.col("k"))).first()
    # at most FAMILIES rows, since each has more than 1/FAMILIES of all
    limit = max(FAMILY, (total or 0) / FAMILIES)
    large = F.broadcast(sizes.filter(F.col("k") > limit).select("parent", F.ceil(F.col("k") / limit).alias("parts")))
    dealt = links.join(large, "parent", "left").withColumn("part", F.pmod(F.xxhash64("child"), F.coalesce("parts", F.lit(1))))
    one, many = F.when(F.col("n") == 1, F.col("child")), F.when(F.col("n") > 1, F.col("child"))
    lists = materialize(dealt.groupBy("parent", "part").agg(F.collect_list(one).alias("one"), F.collect_list(many).alias("many")), "families")
    met = lists.join(lists.select("parent", F.col("part").alias("part2"), F.col("one").alias("one2"), F.col("many").alias("many2")), "parent")
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((n_pairs or 0) / TASK_PAIRS))

    def pairs(*of: Column) -> DataFrame:
        m = met.select("parent", "part", "part2", F.explode(F.array(*of)).alias("m")).select("parent", "part", "part2", "m.xs", "m.ys").filter("size(xs) > 0 AND size(ys) > 0")
        m = m.repartition(tasks, "parent", "part", "part2").select(F.explode("xs").alias("iri"), "ys")
        return m.select("iri", F.explode("ys").alias("node")).filter("iri <> node")

    pair = lambda xs, ys: F.struct(F.col(xs).alias("xs"), ys.alias("ys"))
    once = pairs(pair("one", F.concat("one2", "many2")), pair("many", F.col("one2")))
    return once.unionByName(pairs(pair("many", F.col("many2"))).distinct())


def cousins(edges: DataFrame) -> DataFrame:
    """(iri, node): children of a parent's siblings, without the entity itself and its siblings."""
    sib = siblings(edges)
    up = edges.select(F.col("child").alias("iri"), F.col("parent").alias("p"))
    aunts = up.join(sib.select(F.col("iri").alias("p"), F.col("node").alias("q")), "p")
    kids = aunts.join(edges.select(F.col("parent").alias("q"), F.col("child").alias("node")), "q").select("iri", "node").filter("iri <> node").distinct()
    return kids.join(sib, ["iri", "node"], "left_anti")


def _sibling_counts(links: DataFrame) -> DataFrame:
    """(iri, n): number of siblings of each entity that has any. Pairs are listed only where both have several parents."""
    k = links.groupBy("parent").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("n") == 1, 1)).alias("k1"))
    up = links.select(F.col("child").alias("iri"), "parent", "n").join(k, "parent")
    counted = up.select("iri", F.when(F.col("n") == 1, F.col("k") - 1).otherwise(F.col("k1")).alias("n"))
    many = links.filter("n > 1")
    listed = many.select(F.col("child").alias("iri"), "parent").join(many.select(F.col("child").alias("node"), "parent"), "parent").filter("iri <> node").select("iri", "node").distinct()
    return counted.unionByName(listed.select("iri", F.lit(1).cast("bigint").alias("n"))).groupBy("iri").agg(F.sum("n").alias("n")).filter("n > 0")


def _without_siblings(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Of distinct pairs (iri, node), those without a parent in common."""
    common = pairs.join(links.select(F.col("child").alias("iri"), "parent"), "iri").join(links.select(F.col("child").alias("node"), "parent"), ["node", "parent"])
    return pairs.join(common.select("iri", "node"), ["iri", "node"], "left_anti")


def _cousin_counts(links: DataFrame) -> DataFrame:
    """(iri, n): number of cousins of each entity that has any.

    Let x and its parent p have one parent each, p's being g, and let y have one parent q. Then x and y are cousins where q is
    another child of g, they are met once and share no parent. So x has as many of those as the children of g
    have children with one parent, less those of p. All other pairs are listed.
    """
    up = links.select(F.col("child").alias("iri"), F.col("parent").alias("p"), F.col("n").alias("n_iri"))
    over = links.select(F.col("child").alias("p"), F.col("parent").alias("g"), F.col("n").alias("n_p"))
    beside = links.select(F.col("child").alias("q"), F.col("parent").alias("g"))
    down = links.select(F.col("child").alias("node"), F.col("parent").alias("q"), F.col("n").alias("n_node"))
    k1 = links.filter("n = 1").groupBy("parent").agg(F.count(F.lit(1)).alias("k1"))
    under = beside.join(k1.withColumnRenamed("parent", "q"), "q").groupBy("g").agg(F.sum("k1").alias("all"))
    fixed = over.filter("n_p = 1").join(k1.withColumnRenamed("parent", "p"), "p").join(under, "g").select("p", (F.col("all") - F.col("k1")).alias("n")).filter("n > 0")
    counted = up.filter("n_iri = 1").join(fixed, "p").select("iri", "n")
    # an entity or a parent of it with several parents, with any other end
    odd = up.join(over, "p").filter("n_iri > 1 OR n_p > 1").join(beside, "g").filter("p <> q").select("iri", "q").distinct()
    listed = odd.join(down, "q").select("iri", "node")
    # another end with several parents, with the other entities
    far = down.filter("n_node > 1").join(beside, "q").join(over.filter("n_p = 1"), "g").filter("p <> q").select("node", "p").distinct()
    listed = listed.unionByName(far.join(up.filter("n_iri = 1"), "p").select("iri", "node")).filter("iri <> node").distinct()
    listed = _without_siblings(materialize(listed, "cousins"), links)
    return counted.unionByName(listed.select("iri", F.lit(1).cast("bigint").alias("n"))).groupBy("iri").agg(F.sum("n").alias("n"))


def cousin_counts(edges: DataFrame) -> DataFrame:
    """(iri, n): how many `cousins` each entity has that has any, without listing them where the links are a tree."""
    return _cousin_counts(_links(edges))


def relations(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(iri, relation, node): layers by depth in both directions, any ancestor, any descendant, siblings, cousins, any of them."""
    parts = []
    for direction, name in (("up", "ancestor"), ("down", "descendant")):
        lay = layers(edges, direction, depth)
        parts.append(lay.select("iri", F.concat(F.lit(f"{name}_d"), F.col("depth")).alias("relation"), "node"))
        parts.append(lay.select("iri", F.lit(f"{name}s_any").alias("relation"), "node"))
    parts.append(siblings(edges).select("iri", F.lit("siblings").alias("relation"), "node"))
    parts.append(cousins(edges).select("iri", F.lit("cousins").alias("relation"), "node"))
    base = materialize(union_all(parts), "relations")
    near = base.filter(F.col("relation").isin("ancestors_any", "descendants_any", "siblings", "cousins")).select("iri", F.lit("neighbors_any").alias("relation"), "node").distinct()
    return base.unionByName(near)


def relation_sizes(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(relation, n, n_entities): numbers of pairs and of entities of each relation that `relations` gives, counted without
    listing siblings and cousins where the links are a tree. A descendant is an ancestor seen from the other end."""
    links = _links(edges)
    # children without children of their own and with one parent have the same ancestors: the first stands for all of a parent
    above = links.select(F.col("parent").alias("child")).distinct().withColumn("above", F.lit(1))
    marked = materialize(links.join(above, "child", "left"), "links")
    plain = F.col("above").isNull() & (F.col("n") == 1)
    slim = marked.filter(~plain).select("child", "parent", F.lit(1).cast("bigint").alias("w"))
    slim = materialize(slim.unionByName(marked.filter(plain).groupBy("parent").agg(F.min("child").alias("child"), F.count(F.lit(1)).alias("w"))), "links")
    weight = slim.filter("w > 1").select(F.col("child").alias("iri"), "w")
    up = materialize(layers(slim, "up", depth).join(weight, "iri", "left").na.fill(1, ["w"]), "ancestors")
    ends = up.select(F.explode(F.array(F.struct(F.lit("ancestor").alias("name"), F.col("iri").alias("iri"), F.col("w").alias("e")), F.struct(F.lit("descendant").alias("name"), F.col("node").alias("iri"), F.lit(1).cast("bigint").alias("e")))).alias("x"), "depth", "w")
    by = materialize(ends.groupBy("x.name", "depth", "x.iri", "x.e").agg(F.sum("w").alias("c")), "ancestor-counts")
    size = lambda relation: by.groupBy(relation.alias("relation"), "iri").agg(F.sum("c").alias("c"), F.max("e").alias("e")).groupBy("relation").agg(F.sum("c").alias("n"), F.sum("e").alias("n_entities"))
    parts = [size(F.concat("name", F.lit("_d"), F.col("depth"))), size(F.concat("name", F.lit("s_any")))]
    one = lambda df, name: df.agg(F.lit(name).alias("relation"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_entities"))
    beside = [materialize(one(_sibling_counts(links), "siblings"), "sizes"), materialize(one(_cousin_counts(links), "cousins"), "sizes")]
    # of the ancestors those that are neither siblings nor cousins, and of those the ones met from both ends, in cycles
    pairs = up.select("iri", "node", "w")
    inner = marked.filter("above = 1").select("child", "parent")
    over = slim.select(F.col("child").alias("iri"), "parent")
    two = over.withColumnRenamed("parent", "p").join(inner.select(F.col("child").alias("p"), F.col("parent").alias("g")), "p")
    two2 = inner.select(F.col("child").alias("node"), F.col("parent").alias("q")).join(inner.select(F.col("child").alias("q"), F.col("parent").alias("g")), "q")
    common = pairs.join(over, "iri").join(inner.withColumnRenamed("child", "node"), ["node", "parent"]).select("iri", "node", "w")
    cousin = pairs.join(two, "iri").join(two2, ["node", "g"]).filter("p <> q").select("iri", "node", "w")
    near = materialize(common.unionByName(cousin).distinct(), "near")
    both = pairs.join(pairs.select(F.col("node").alias("iri"), F.col("iri").alias("node")), ["iri", "node"], "left_semi")
    total = lambda df: df.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    rest = 2 * (total(pairs) - total(near)) - total(both.join(near.select("iri", "node"), ["iri", "node"], "left_anti"))
    n_any = union_all(beside).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()[0] + rest
    parts += [*beside, by.groupBy("iri").agg(F.max("e").alias("e")).agg(F.lit("neighbors_any").alias("relation"), F.lit(n_any).cast("bigint").alias("n"), F.sum("e").alias("n_entities"))]
    return union_all(parts).filter("n > 0")


def annotations(triples: DataFrame, needed: DataFrame, max_literals: int = 64) -> DataFrame:
    """(iri, tag, role, value): literal annotations of the needed entities, distinct, at most `max_literals` per tag, by text."""
    t = triples.filter((F.col("o_kind") == "literal") & F.col("o").isNotNull()).select(F.col("s").alias("iri"), local_name(F.col("p")).alias("tag"), F.col("o").alias("value")).distinct()
    t = t.join(needed.select("iri").distinct(), "iri", "left_semi")
    w = Window.partitionBy("iri", "tag").orderBy("value")
    return t.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_literals).drop("rn").withColumn("role", tag_role(F.col("tag")))


def tag_inventory(triples: DataFrame) -> DataFrame:
    """(tag, o_kind, n): uses of each property by kind of object."""
    return triples.groupBy(local_name(F.col("p")).alias("tag"), "o_kind").agg(F.count(F.lit(1)).alias("n"))


def role_texts(notes: DataFrame, limit: int = 64) -> DataFrame:
    """(iri, role, vals): distinct non-empty normal forms by role, at most `limit`, by text."""
    v = notes.select("iri", "role", normal_form(F.col("value")).alias("v")).filter("v <> ''").distinct()
    w = Window.partitionBy("iri", "role").orderBy("v")
    return v.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).groupBy("iri", "role").agg(F.array_sort(F.collect_list("v")).alias("vals"))


def relation_texts(rel: DataFrame, ents: DataFrame, limit: int = 64) -> DataFrame:
    """(iri, relation, n_nodes, vals): normal forms of the related labels, the first `limit` distinct ones by node."""
    lab = ents.select(F.col("iri").alias("node"), normal_form(F.col("label")).alias("v"))
    sizes = rel.groupBy("iri", "relation").agg(F.count(F.lit(1)).alias("n_nodes"))
    firsts = rel.join(lab, "node").filter("v <> ''").groupBy("iri", "relation", "v").agg(F.min("node").alias("node"))
    w = Window.partitionBy("iri", "relation").orderBy("node", "v")
    texts = firsts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).groupBy("iri", "relation").agg(F.array_sort(F.collect_list("v")).alias("vals"))
    empty = F.expr("CAST(array() AS array<string>)")
    return sizes.join(texts, ["iri", "relation"], "left").withColumn("vals", F.coalesce("vals", empty))


def profiles(ents: DataFrame, edges: DataFrame, notes: DataFrame, depth: int = 4, limit: int = 64) -> DataFrame:
    """One row per entity: label in normal form, texts by role (map), tags, related texts and node counts by relation (maps)."""
    roles = role_texts(notes, limit).groupBy("iri").agg(F.map_from_entries(F.collect_list(F.struct("role", "vals"))).alias("role_texts"))
    tags = notes.groupBy("iri").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    rel = relation_texts(relations(edges, depth), ents, limit)
    rels = rel.groupBy("iri").agg(F.map_from_entries(F.collect_list(F.struct("relation", "vals"))).alias("relation_texts"), F.map_from_entries(F.collect_list(F.struct("relation", "n_nodes"))).alias("relation_sizes"))
    return ents.withColumn("label_norm", normal_form(F.col("label"))).join(roles, "iri", "left").join(tags, "iri", "left").join(rels, "iri", "left")


def neighbourhood_documents(ents: DataFrame, edges: DataFrame, most: int = 20, own: bool = False) -> DataFrame:
    """(iri, document): labels of up to `most` parents and children, by identifier, joined by ' | ', the own label first on request."""
    near = edges.select(F.col("child").alias("iri"), F.col("parent").alias("node")).unionByName(edges.select(F.col("parent").alias("iri"), F.col("child").alias("node"))).distinct()
    w = Window.partitionBy("iri").orderBy("node")
    near = near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    lab = ents.select(F.col("iri").alias("node"), "label")
    docs = near.join(lab, "node").groupBy("iri").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("x"))
    docs = docs.select("iri", F.transform("x", lambda v: v["label"]).alias("x"))
    out = ents.select("iri", "label").join(docs, "iri", "left").withColumn("x", F.coalesce("x", F.expr("CAST(array() AS array<string>)")))
    return out.select("iri", F.array_join(F.concat(F.array("label"), F.col("x")) if own else F.col("x"), " | ").alias("document"))


def _first_distinct(values: Column, most: int) -> Column:
    """Values squeezed, equal ones but for case once, first seen first."""
    clean = F.filter(F.transform(values, squeeze), lambda x: x != "")
    low = F.transform(clean, F.lower)
    kept = F.filter(clean, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.slice(kept, 1, most)


def concept_texts(ents: DataFrame, edges: DataFrame, notes: DataFrame, synonyms: int = 4, definitions: int = 2, parents: int = 4, children: int = 4) -> DataFrame:
    """(iri, text): 'Label: .. [SEP] Definition: .. [SEP] Synonyms: .. [SEP] Parents: .. [SEP] Children: ..', absent parts left out."""
    none = F.expr("CAST(array() AS array<string>)")
    lab = ents.select(F.col("iri").alias("node"), "label")

    def near(key: str, other: str, name: str) -> DataFrame:
        e = edges.select(F.col(key).alias("iri"), F.col(other).alias("node")).join(lab, "node")
        return e.groupBy("iri").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias(name)).select("iri", F.transform(name, lambda v: v["label"]).alias(name))

    of_role = lambda role: notes.filter(F.col("role") == role).groupBy("iri").agg(F.array_sort(F.collect_list("value")).alias(role))
    t = ents.select("iri", "label", "synonyms").join(of_role("definition"), "iri", "left").join(near("child", "parent", "up"), "iri", "left").join(near("parent", "child", "down"), "iri", "left")
    parts = [F.concat(F.lit("Label: "), squeeze(F.col("label")))]
    for name, column, most in (("Definition", "definition", definitions), ("Synonyms", "synonyms", synonyms), ("Parents", "up", parents), ("Children", "down", children)):
        kept = _first_distinct(F.coalesce(F.col(column), none), most)
        parts.append(F.when(F.size(kept) > 0, F.concat(F.lit(f"{name}: "), F.array_join(kept, "; "))))
    return t.select("iri", F.concat_ws(" [SEP] ", *parts).alias("text"))


def by_property_end(triples: DataFrame, ends: tuple[str, ...], most: int = 8) -> DataFrame:
    """(iri, vals): literals of properties whose name ends, but for case, in one of `ends`; at most `most`, by text."""
    t = triples.filter((F.col("o_kind") == "literal") & F.lower("p").rlike(f"({'|'.join(ends)})$")).select(F.col("s").alias("iri"), F.col("o").alias("v")).distinct()
    return t.groupBy("iri").agg(F.slice(F.array_sort(F.collect_list("v")), 1, most).alias("vals"))


def undirected(edges: DataFrame) -> DataFrame:
    """(x, y): distinct links in both directions without loops."""
    return edges.select(F.col("child").alias("x"), F.col("parent").alias("y")).unionByName(edges.select(F.col("parent").alias("x"), F.col("child").alias("y"))).filter("x <> y").distinct()


def fingerprint(ents: DataFrame, key: str = "iri") -> DataFrame:
    """One row: number of identifiers and a hash that doesn't depend on their order."""
    d = ents.select(F.col(key).alias("k")).distinct()
    return d.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.sum(F.xxhash64("k").cast("decimal(38,0)")).cast("string"), 256).alias("digest"))


def tag_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src_iri, tgt_iri, src_tag, tgt_tag): tags of a pair that share a normalized value. left, right: (iri, tag, value)."""
    v = lambda df, side: df.select(F.col("iri").alias(f"{side}_iri"), F.col("tag").alias(f"{side}_tag"), normal_form(F.col("value")).alias("v")).filter("v <> ''").distinct()
    j = pairs.select("src_iri", "tgt_iri").distinct().join(v(left, "src"), "src_iri").join(v(right, "tgt"), ["tgt_iri", "v"])
    return j.select("src_iri", "tgt_iri", "src_tag", "tgt_tag").distinct()


def support(pairs: DataFrame, rel_src: DataFrame, rel_tgt: DataFrame, gold: DataFrame) -> DataFrame:
    """(src_iri, tgt_iri, relation, support): known links between the nodes two entities have in one relation."""
    a = rel_src.select(F.col("iri").alias("src_iri"), "relation", F.col("node").alias("a"))
    b = rel_tgt.select(F.col("iri").alias("tgt_iri"), F.col("relation").alias("r2"), F.col("node").alias("b"))
    g = gold.select(F.col("src_iri").alias("a"), F.col("tgt_iri").alias("b")).distinct()
    j = pairs.select("src_iri", "tgt_iri").distinct().join(a, "src_iri").join(g, "a").join(b.withColumnRenamed("r2", "relation"), ["tgt_iri", "relation", "b"])
    return j.groupBy("src_iri", "tgt_iri", "relation").agg(F.count(F.lit(1)).alias("support"))
