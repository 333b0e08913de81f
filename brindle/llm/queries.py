"""The queries of this subpackage: one operator each, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.normal import normal_forms, normal_words
from brindle.llm import distinct_terms, entity_match, median_rank, mixing, packing, reading_level, set_join, splits, top_n
from brindle.llm.common import blank, canonical_iri, clean_score
from brindle.llm.components import components
from brindle.llm.tokens import token_count
from brindle.sources.materialize import write_table
from brindle.sources.tables import table

CAPACITY = 1024
SCORES = ["sapbert_cosine", "graph06_score", "model_score"]


def _strings(name: str):
    return F.coalesce(F.col(name), F.expr("CAST(array() AS array<string>)"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, side: table(spark, d, name).select("iri", "label_raw", "label_tokens", "labels", "literals", F.lit(side).alias("side"))
    return one("src_profiles", 0).unionByName(one("tgt_profiles", 1))


# 1: entity matching


def _matches(spark: SparkSession, d: str) -> DataFrame:
    ents = entity_match.entities(_profiles(spark, d), "iri", F.col("side"), F.concat(F.array("label_raw"), _strings("labels"), _strings("literals")))
    return entity_match.match(ents)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a source and a target identifier that are matched with a posterior of a half or more."""
    return _matches(spark, d).filter("posterior >= 0.5 AND sa <> sb").select(F.when(F.col("sa") == 0, F.col("a")).otherwise(F.col("b")).alias("src_iri"), F.when(F.col("sa") == 0, F.col("b")).otherwise(F.col("a")).alias("tgt_iri")).distinct()


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every compared pair, within a source too, with its similarities and its confidence."""
    m = _matches(spark, d)
    return m.select(F.col("a").alias("iri_a"), F.col("b").alias("iri_b"), (F.col("sa") == F.col("sb")).alias("same_source"), F.round("x0", 4).alias("meaning"), F.round("x2", 4).alias("names"), F.round("posterior", 6).alias("confidence"))


# 2: distinctive terms


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    sides = [c.select(F.col(f"{s}_iri").alias("iri"), F.col(f"{s}_label").alias("label")) for s in ("src", "tgt")]
    both = sides[0].unionByName(sides[1]).filter(F.col("iri").isNotNull() & ~blank(F.col("label"))).distinct()
    return both.select("iri", normal_words(F.col("label")).alias("words"))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """Each term of each labelled entity with its enrichment score."""
    s = distinct_terms.term_scores(_labelled(spark, d), "iri", "words")
    return s.select("iri", "term", "k", "n", "df", F.round("score", 6).alias("score"), F.round("q", 9).alias("q"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs with each term both labels hold that is distinctive enough to be of at most 8 entities, and is."""
    scores = distinct_terms.term_scores(_labelled(spark, d), "iri", "words", max_df=8)
    c = table(spark, d, "candidates").filter(F.col("src_iri").isNotNull() & F.col("tgt_iri").isNotNull() & ~blank(F.col("src_label")) & ~blank(F.col("tgt_label")))
    pairs = distinct_terms.telling_pairs(scores, "iri", 8, c, "src_iri", "tgt_iri", F.col("src_label"), F.col("tgt_label"), normal_words)
    return pairs.select("src_iri", "tgt_iri", "term")


# 3: similar sets

_FIELDS = {"label_tokens": "0.8", "labels": "0.6"}


def _sets(spark: SparkSession, d: str, field: str) -> DataFrame:
    p = _profiles(spark, d).select("iri", F.col(field).alias("e"))
    if field == "labels":  # values in normal form, blank ones dropped
        p = p.select("iri", F.filter(normal_forms(F.col("e")), lambda v: v != "").alias("e"))
    return write_table(set_join.class_table(p, "iri", "e"), f"sets-{field}").df


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of identifiers with strongly overlapping label_tokens or labels."""
    out = None
    for field, t in _FIELDS.items():
        members = _sets(spark, d, field)
        pairs = set_join.expand_pairs(members, set_join.similar_classes(members, t))
        pairs = pairs.select(F.col("record_a").alias("iri_a"), F.col("record_b").alias("iri_b"), F.lit(field).alias("field_name"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per identifier, field and class of equal sets, with its copies and its links to other classes."""
    out = None
    for field, t in _FIELDS.items():
        members = _sets(spark, d, field)
        links = set_join.link_counts(members, set_join.similar_classes(members, t)).withColumn("field_name", F.lit(field)).withColumnRenamed("record", "iri")
        out = links if out is None else out.unionByName(links)
    return out


# 4: splits


def _rows_to_split(spark: SparkSession, d: str) -> DataFrame:
    """The rows of both tables; a row without a source also with its whole content, which tells it from others."""
    none = F.lit(None).cast("int")

    def part(name: str, source: str, from_train: int, label) -> DataFrame:
        src = canonical_iri(F.col(source))
        return table(spark, d, name).select(src.alias("src_iri"), F.col("fold").cast("int").alias("fold"), F.lit(from_train).alias("from_train"), label.alias("label"), F.when(src.isNull(), F.to_json(F.struct("*"))).alias("content"))

    return part("train", "srcentity", 1, none).unionByName(part("oof_scores", "src_iri", 0, F.col("label").cast("int")))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    labels = {"n_train": F.col("from_train") == 1, "n_positive": F.col("label") == 1, "n_negative": F.col("label") == 0}
    s = splits.grouped_splits(_rows_to_split(spark, d), ["src_iri"], labels, table(spark, d, "split_targets"), audit="fold", alone=True)
    own = lambda is_alone: F.when(F.col("alone") == is_alone, F.col("component"))
    return s.select(own(False).alias("src_iri"), own(True).alias("row_key"), *[c for c in s.columns if c not in ("component", "alone")])


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every source entity with its split, its rows by label and the number of folds it has now.

    A row without a source entity comes by itself, with a key made of its content and occurrence.
    """
    return _splits(spark, d)


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each split holds, beside its target."""
    s = _splits(spark, d).groupBy("split").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_train", "n_positive", "n_negative")], F.count("src_iri").alias("n_entities"))
    t = table(spark, d, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    from pyspark.sql import Window

    total = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))  # as many rows as splits
    return t.join(s, "split", "left").withColumn("share", F.round(F.col("n_rows") / total, 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Source entities whose rows, all of them now in one split, carry several of the present folds."""
    return _splits(spark, d).filter("n_fold >= 2").select("src_iri")


# 5: one ranking


def _scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidate pairs with the highest of each score, in one aggregation over the three tables."""
    names = ["sapbert_cosine", "graph06_score", "model_score"]
    none = F.lit(None).cast("double")

    def part(df: DataFrame, name: str, candidate: int) -> DataFrame:
        return df.filter(F.col("src_iri").isNotNull() & F.col("tgt_iri").isNotNull()).select("src_iri", "tgt_iri", *[(clean_score(F.col(n)) if n == name else none).alias(n) for n in names], F.lit(candidate).alias("c"))

    rows = part(table(spark, d, "candidates"), "sapbert_cosine", 1).unionByName(part(table(spark, d, "union_scores").filter("from_graph06 = 1"), "graph06_score", 0)).unionByName(part(table(spark, d, "predictions"), "model_score", 0))
    return rows.groupBy("src_iri", "tgt_iri").agg(*[F.max(n).alias(n) for n in names], F.max("c").alias("c")).filter("c = 1").drop("c")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Each source's targets in one order by median rank."""
    r = median_rank.rank_items(_scored_pairs(spark, d), "src_iri", "tgt_iri", SCORES)
    return r.select("src_iri", "tgt_iri", *[f"rank_{s}" for s in SCORES], "median_rank", F.round("mean_rank", 6).alias("mean_rank"), "place")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The pair of a source that beats each other one on two of three scores: of those whose median and mean rank allow it, by an exact check."""
    r = write_table(median_rank.rank_items(_scored_pairs(spark, d), "src_iri", "tgt_iri", SCORES), "ranked").df
    return median_rank.majority_winners(r, "src_iri", "tgt_iri", SCORES, least_items=3)


# 6: top n


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best targets of every source by cosine."""
    return top_n.top_n(table(spark, d, "candidates"), "src_iri", "tgt_iri", "sapbert_cosine", 5).select("src_iri", "tgt_iri")


def p6_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The ten best targets of every source, beside the best rank recorded for the pair."""
    best = top_n.top_n(table(spark, d, "candidates"), "src_iri", "tgt_iri", "sapbert_cosine", 10)
    recorded = table(spark, d, "candidates").filter(F.col("src_iri").isNotNull() & F.col("tgt_iri").isNotNull())
    recorded = recorded.groupBy("src_iri", "tgt_iri").agg(F.min(F.when(F.abs("rank_src_tgt") < 1e300, F.col("rank_src_tgt"))).alias("recorded_rank"))
    return best.join(recorded, ["src_iri", "tgt_iri"], "left").select("src_iri", "tgt_iri", "rank", "sapbert_cosine", "recorded_rank")


# 7: components


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").select(canonical_iri(F.col("srcentity")).alias("a"), canonical_iri(F.col("tgtentity")).alias("b"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every linked entity with the smallest identifier of its group."""
    return components(_links(spark, d), "a", "b").withColumnsRenamed({"node": "entity_iri", "group": "group_iri"})


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = components(_links(spark, d), "a", "b").groupBy("group").agg(F.count(F.lit(1)).alias("n_entities"))
    return sizes.groupBy("n_entities").agg(F.count(F.lit(1)).alias("n_groups"))


# 8: containers


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
    return packing.pack(docs, "doc_id", "tokens", CAPACITY)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container."""
    return _packed(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text lies in several containers."""
    return _packed(spark, d).groupBy("doc_id").agg(F.count_distinct("container").alias("n"), F.count(F.when(F.col("piece") == 1, 1)).alias("copies")).filter("n > copies").select("doc_id")


# 9: mix


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens"))
    return mixing.mix(docs, "doc_id", "source", "tokens", table(spark, d, "mix_targets"))


def p9_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is taken."""
    return _mixed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """What each source should give and gives."""
    return _mixed(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the draw exhausts below their share."""
    return _mixed(spark, d)[1].filter("short").select("source")


# 10: reading level


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "reading_labels"), "doc_id", "grade_band")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its level."""
    return _levels(spark, d).select("doc_id", "language", "n_words", F.round("level", 4).alias("level"), "band", F.round("p_band", 4).alias("p_band"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents written for specialists."""
    return _levels(spark, d).filter("band = 3").select("doc_id").distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_terms, p3_found, p3_links, p4_found, p4_splits, p4_shares, p5_found, p5_ranking, p6_found, p6_ranks, p7_found, p7_sizes, p8_found, p8_containers, p9_found, p9_drawn, p9_report, p10_found, p10_levels)}
