"""Pair feature blocks: the 79 base columns, ROUGE and retrieval columns, and the 313 deep columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.clouds import SPECTRAL, TDA, spectral_pair_col, tda_pair_col
from brindle.functions.normal import normal_form
from brindle.functions.sequences import NLP, SYNTAX, gestalt_col, nlp_col, syntax_col
from brindle.functions.vector import CLASSICAL, classical_col
from brindle.operators import ontology
from brindle.operators.pairs import KEY, assemble, scrub
from brindle.operators.ranking import ecdf
from brindle.sources.materialize import materialize
from brindle.plans.registry import BASE, DEEP, DEPTH, META, RETRIEVAL, ROLES, ROUGE, relation_names


def _spread(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    return df.withColumn("_x", struct).select(*KEY, *[F.col(f"_x.{n}").alias(n) for n in names])


def syntax_block(pairs: DataFrame, src: str = "src_label", tgt: str = "tgt_label") -> DataFrame:
    return _spread(pairs, syntax_col(F.col(src), F.col(tgt)), SYNTAX)


def nlp_block(pairs: DataFrame, src: str = "src_label", tgt: str = "tgt_label") -> DataFrame:
    return _spread(pairs, nlp_col(F.coalesce(src, F.lit("")), F.coalesce(tgt, F.lit(""))), NLP)


def classical_block(pairs: DataFrame, src: str = "src_vec", tgt: str = "tgt_vec") -> DataFrame:
    return _spread(pairs, classical_col(F.col(src), F.col(tgt)), CLASSICAL)


def spectral_block(pairs: DataFrame, src: str = "src_cloud", tgt: str = "tgt_cloud") -> DataFrame:
    return _spread(pairs, spectral_pair_col(F.col(src), F.col(tgt)), SPECTRAL)


def topology_block(pairs: DataFrame, src: str = "src_cloud", tgt: str = "tgt_cloud") -> DataFrame:
    return _spread(pairs, tda_pair_col(F.col(src), F.col(tgt)), TDA)


class FeaturePipeline:
    """Groups of base features that can be switched on one by one; all give the 79 columns in the contract's order.

    pairs: one row per pair with src_/tgt_ label, vec and cloud, as far as the groups need them.
    """

    GROUPS = {"syntax": (syntax_block, SYNTAX), "classical": (classical_block, CLASSICAL), "spectral": (spectral_block, SPECTRAL), "topology": (topology_block, TDA), "nlp": (nlp_block, NLP)}

    def __init__(self, groups: tuple[str, ...] = ("syntax", "classical", "spectral", "topology")):
        unknown = set(groups) - set(self.GROUPS)
        if unknown:
            raise ValueError(f"unknown groups {sorted(unknown)}")
        self.groups = groups

    def names(self) -> list[str]:
        return [n for g in self.groups for n in self.GROUPS[g][1]]

    def transform(self, pairs: DataFrame) -> DataFrame:
        """(src_iri, tgt_iri, features): every group in one pass over the pairs, no join."""
        cols = {"syntax": lambda: syntax_col("src_label", "tgt_label"), "classical": lambda: classical_col("src_vec", "tgt_vec"), "spectral": lambda: spectral_pair_col("src_cloud", "tgt_cloud"), "topology": lambda: tda_pair_col("src_cloud", "tgt_cloud"), "nlp": lambda: nlp_col("src_label", "tgt_label")}
        df = pairs
        for g in self.groups:
            df = df.withColumn(f"_{g}", cols[g]())
        out = df.select(*KEY, *[F.col(f"_{g}.{n}").alias(n) for g in self.groups for n in self.GROUPS[g][1]])
        return scrub(out, self.names())


def base_features(pairs: DataFrame) -> DataFrame:
    """The 79 columns."""
    out = FeaturePipeline().transform(pairs)
    if out.columns[len(KEY) :] != BASE:
        raise ValueError("feature contract broken")
    return out


def retrieval_block(union: DataFrame, reference: DataFrame) -> DataFrame:
    """Graph score, its share of training graph scores at or below it (0 where not from the graph) and provenance."""
    u = ecdf(union, "graph06_score", reference.filter("from_graph06 = 1"), "graph06_score", "graph06_cdf")
    return u.withColumn("graph06_cdf", F.when(F.col("from_graph06") == 1, F.coalesce("graph06_cdf", F.lit(0.0))).otherwise(F.lit(0.0))).select(*KEY, *RETRIEVAL)


def meta_features(pairs: DataFrame, union: DataFrame, reference: DataFrame) -> DataFrame:
    """The 90 columns."""
    base, nlp = base_features(pairs), nlp_block(pairs).select(*KEY, *ROUGE)
    out = assemble(pairs, {"": base}).join(nlp, KEY, "left").join(retrieval_block(union, reference), KEY, "left")
    return scrub(out.select(*KEY, *META), META)


_NONE = "CAST(array() AS array<string>)"


def _texts(m: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(m), F.lit(key)), F.expr(_NONE))


def deep_features(pairs: DataFrame, src: DataFrame, tgt: DataFrame, rel_src: DataFrame, rel_tgt: DataFrame, gold: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The lexical and structural columns of `pairs`. src, tgt: profiles; rel_*: relations; gold: training links.

    Text features are expressions over the two profiles of a pair; support counts, which look at links between
    neighbours, are one join per kind on the neighbours and a pivot.
    """
    names = {"all_labels": "all", "all_literals": "lit"} | {f"role_{r}": f"role_{r}" for r in ROLES} | {r: r for r in relation_names(depth)}

    def take(p: DataFrame, s: str) -> DataFrame:
        """One side's texts, each with its words, computed once and written, so that the pair plan stays small."""
        roles = F.coalesce("role_texts", F.expr("CAST(map() AS map<string,array<string>>)"))
        vals = {"all": F.coalesce("all_labels", F.expr(_NONE)), "lit": F.array_distinct(F.flatten(F.map_values(roles))), "concept": F.filter(F.array("label_norm"), lambda x: x != "")}
        vals |= {f"role_{r}": _texts("role_texts", r) for r in ROLES} | {r: _texts("relation_texts", r) for r in relation_names(depth)}
        size = lambda r: F.coalesce(F.try_element_at(F.col("relation_sizes"), F.lit(r)), F.lit(0)).cast("double")
        base = p.select(F.col("iri").alias(f"{s}_iri"), F.col("label_norm").alias(f"{s}_l"), F.coalesce("tags", F.expr(_NONE)).alias(f"{s}_tags"), *[v.alias(f"{s}v_{k}") for k, v in vals.items()], *[size(r).alias(f"{s}n_{r}") for r in relation_names(depth)])
        return materialize(base.withColumns({f"{s}w_{k}": T.token_set(F.col(f"{s}v_{k}")) for k in vals}), "texts")

    d = pairs.select(*KEY).distinct().join(take(src, "src"), "src_iri").join(take(tgt, "tgt"), "tgt_iri")
    d = d.withColumn("_ratio", gestalt_col("src_l", "tgt_l"))
    d = d.withColumns({"_wa": T.words(F.col("src_l")), "_wb": T.words(F.col("tgt_l"))})

    def compare(x: str, y: str, prefix: str) -> dict[str, Column]:
        u, v, tu, tv = (F.col(c) for c in (f"srcv_{x}", f"tgtv_{y}", f"srcw_{x}", f"tgtw_{y}"))
        return {f"{prefix}_exact_count": F.size(F.array_intersect(u, v)).cast("double"), f"{prefix}_value_jaccard": T.jaccard(u, v), f"{prefix}_token_jaccard": T.jaccard(tu, tv), f"{prefix}_token_dice": T.dice(tu, tv), f"{prefix}_token_overlap": T.overlap(tu, tv)}

    a, b, wa, wb = F.col("src_l"), F.col("tgt_l"), F.col("_wa"), F.col("_wb")
    ta, tb = F.array_distinct(wa), F.array_distinct(wb)
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    f: dict[str, Column] = {
        "label_exact_normalized": one((a != "") & (a == b)), "label_sequence_ratio": F.col("_ratio"),
        "label_token_jaccard": T.jaccard(ta, tb), "label_token_dice": T.dice(ta, tb), "label_token_overlap": T.overlap(ta, tb),
        "label_token_containment": one((F.size(ta) > 0) & ((F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0))),
        "label_prefix": one((a != "") & (F.startswith(a, b) | F.startswith(b, a))), "label_suffix": one((a != "") & (F.endswith(a, b) | F.endswith(b, a))),
        "label_length_difference": F.abs(F.length(a) - F.length(b)).cast("double"), "label_token_count_difference": F.abs(F.size(ta) - F.size(tb)).cast("double"),
        "acronym_exact": one((T.acronym(a) != "") & (T.acronym(a) == T.acronym(b))),
        "digit_exact": one((F.size(T.digit_set(a)) > 0) & (F.array_sort(T.digit_set(a)) == F.array_sort(T.digit_set(b)))),
        "tag_count_src": F.size("src_tags").cast("double"), "tag_count_tgt": F.size("tgt_tags").cast("double"), "tag_count_difference": F.abs(F.size("src_tags") - F.size("tgt_tags")).cast("double"),
        "tag_common_count": F.size(F.array_intersect("src_tags", "tgt_tags")).cast("double"), "tag_jaccard": T.jaccard(F.col("src_tags"), F.col("tgt_tags")),
    }
    for n in range(2, 7):
        f[f"char_ngram_{n}_jaccard"] = T.jaccard(T.char_ngram_set(a, n), T.char_ngram_set(b, n))
    for n in range(1, 4):
        f[f"word_ngram_{n}_jaccard"] = T.jaccard(T.word_ngram_set(wa, n), T.word_ngram_set(wb, n))
    for prefix, key in names.items():
        f |= compare(key, key, prefix)
    for r in relation_names(depth):
        n, m = F.col(f"srcn_{r}"), F.col(f"tgtn_{r}")
        f |= {f"{r}_count_src": n, f"{r}_count_tgt": m, f"{r}_count_difference": F.abs(n - m)}
    for x in range(1, depth + 1):
        for y in range(1, depth + 1):
            for k in ("ancestor", "descendant"):
                f[f"cross_{k}_d{x}_d{y}_token_jaccard"] = T.jaccard(F.col(f"srcw_{k}_d{x}"), F.col(f"tgtw_{k}_d{y}"))
                f[f"cross_{k}_d{x}_d{y}_exact_count"] = F.size(F.array_intersect(f"srcv_{k}_d{x}", f"tgtv_{k}_d{y}")).cast("double")
    for r in ("ancestors_any", "descendants_any", "siblings", "cousins"):
        f |= compare("concept", r, f"src_concept_to_tgt_{r}") | compare(r, "concept", f"src_{r}_to_tgt_concept")
    wide = materialize(d.select(*KEY, *[c.alias(n) for n, c in f.items()]), "deep")
    same = ontology.support(pairs, rel_src, rel_tgt, gold).select(*KEY, F.concat(F.lit("train_support_"), "relation").alias("name"), "support")
    levels = lambda rel: rel.filter(F.col("relation").rlike("^(ancestor|descendant)_d"))
    cross = None
    for k in ("ancestor", "descendant"):
        ra = levels(rel_src).filter(F.col("relation").startswith(k)).select("iri", F.lit(k).alias("relation"), "node", F.regexp_extract("relation", "_(d[0-9]+)$", 1).alias("da"))
        rb = levels(rel_tgt).filter(F.col("relation").startswith(k)).select("iri", "node", F.regexp_extract("relation", "_(d[0-9]+)$", 1).alias("db"))
        g = gold.select(F.col("src_iri").alias("a"), F.col("tgt_iri").alias("b")).distinct()
        j = pairs.select(*KEY).distinct().join(ra.select(F.col("iri").alias("src_iri"), F.col("node").alias("a"), "da"), "src_iri").join(g, "a").join(rb.select(F.col("iri").alias("tgt_iri"), F.col("node").alias("b"), "db"), ["tgt_iri", "b"])
        j = j.groupBy(*KEY, F.concat(F.lit(f"train_support_cross_{k}_"), "da", F.lit("_"), "db").alias("name")).agg(F.count(F.lit(1)).alias("support"))
        cross = j if cross is None else cross.unionByName(j)
    supported = [n for n in DEEP if n.startswith("train_support_")]
    supports = same.unionByName(cross).groupBy(*KEY).pivot("name", supported).agg(F.max("support"))
    out = wide.join(supports, KEY, "left")
    return out.select(*KEY, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in DEEP])


def normalized_profiles(ents: DataFrame, edges: DataFrame, notes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """ontology.profiles with all labels in normal form, as deep_features needs them."""
    p = ontology.profiles(ents, edges, notes, depth)
    exploded = ents.select("iri", F.explode("all_labels").alias("v")).select("iri", normal_form(F.col("v")).alias("v")).filter("v <> ''")
    return p.drop("all_labels").join(exploded.groupBy("iri").agg(F.array_sort(F.collect_set("v")).alias("all_labels")), "iri", "left").withColumn("all_labels", F.coalesce("all_labels", F.expr(_NONE)))
