"""Views over the test tables that the queries share, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.tables import table


def gold(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train").select(F.col("srcentity").alias("src_iri"), F.col("tgtentity").alias("tgt_iri"), "fold").filter("src_iri IS NOT NULL AND tgt_iri IS NOT NULL")


def cands(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "candidates").filter("src_iri IS NOT NULL AND tgt_iri IS NOT NULL")


def label_pairs(s: SparkSession, d: str) -> DataFrame:
    """One row per candidate pair with both labels (the smallest of each)."""
    return cands(s, d).groupBy("src_iri", "tgt_iri").agg(F.min("src_label").alias("src_label"), F.min("tgt_label").alias("tgt_label"), F.max("label").alias("label"))


def label_strings(s: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of non-null labels."""
    return cands(s, d).filter("src_label IS NOT NULL AND tgt_label IS NOT NULL").select(F.col("src_label").alias("a"), F.col("tgt_label").alias("b")).distinct()


def scored(s: SparkSession, d: str) -> DataFrame:
    """One row per predicted pair: its highest usable score."""
    p = table(s, d, "predictions").filter("src_iri IS NOT NULL AND tgt_iri IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return p.groupBy("src_iri", "tgt_iri").agg(F.max("score").alias("score"))


def oof(s: SparkSession, d: str) -> DataFrame:
    """One row per out-of-fold pair: its highest usable score and label."""
    p = table(s, d, "oof_scores").filter("score IS NOT NULL AND NOT isnan(score)")
    return p.groupBy("src_iri", "tgt_iri").agg(F.max("score").alias("score"), F.max("label").cast("int").alias("label"))


def ents(s: SparkSession, d: str, side: str) -> DataFrame:
    """(iri, label): one row per profile with a label."""
    p = table(s, d, f"{side}_profiles").filter("iri IS NOT NULL AND label <> ''")
    return p.groupBy("iri").agg(F.min("label").alias("label"))


def edges(s: SparkSession, d: str, orders: bool = True) -> DataFrame:
    """The hierarchy region > nation > customer and supplier (> order)."""
    link = lambda t, c, cp, p, pp: table(s, d, t).select(F.concat(F.lit(cp), F.col(c)).alias("child"), F.concat(F.lit(pp), F.col(p)).alias("parent"))
    e = link("nation", "n_nationkey", "n", "n_regionkey", "r").unionByName(link("customer", "c_custkey", "c", "c_nationkey", "n")).unionByName(link("supplier", "s_suppkey", "s", "s_nationkey", "n"))
    return e.unionByName(link("orders", "o_orderkey", "o", "o_custkey", "c")) if orders else e


def nodes(s: SparkSession, d: str) -> DataFrame:
    """(iri, label) of the hierarchy without orders."""
    one = lambda t, k, p, n: table(s, d, t).select(F.concat(F.lit(p), F.col(k)).alias("iri"), F.col(n).alias("label"))
    return one("region", "r_regionkey", "r", "r_name").unionByName(one("nation", "n_nationkey", "n", "n_name")).unionByName(one("customer", "c_custkey", "c", "c_name")).unionByName(one("supplier", "s_suppkey", "s", "s_name"))


def vectors(s: SparkSession, d: str, odd: int | None = None) -> DataFrame:
    v = table(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("iri"), F.col("embedding").alias("vec"), "vec_id", "label")
    return v if odd is None else v.filter(F.col("vec_id") % 2 == odd)


def vector_pairs(s: SparkSession, d: str) -> DataFrame:
    """Neighbouring vectors as pairs."""
    v = table(s, d, "embeddings")
    return v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("i"), F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("i"), F.col("embedding").alias("b")), "i")


def clouds(s: SparkSession, d: str) -> DataFrame:
    """(cloud_id, cloud): blocks of eight vectors."""
    v = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("cloud_id"), F.struct("vec_id", "embedding").alias("x"))
    return v.groupBy("cloud_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("cloud_id", F.transform("x", lambda y: y["embedding"]).alias("cloud"))


SQL = {
    "gold": "SELECT srcentity AS src_iri, tgtentity AS tgt_iri, fold FROM train WHERE srcentity IS NOT NULL AND tgtentity IS NOT NULL",
    "cands": "SELECT * FROM candidates WHERE src_iri IS NOT NULL AND tgt_iri IS NOT NULL",
    "scored": "SELECT src_iri, tgt_iri, max(score) AS score FROM predictions WHERE src_iri IS NOT NULL AND tgt_iri IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL",
    "oof": "SELECT src_iri, tgt_iri, max(score) AS score, max(label)::int AS label FROM oof_scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL",
    "labels": "SELECT DISTINCT src_label AS a, tgt_label AS b FROM candidates WHERE src_iri IS NOT NULL AND tgt_iri IS NOT NULL AND src_label IS NOT NULL AND tgt_label IS NOT NULL",
    "src_ents": "SELECT iri, min(label) AS label FROM src_profiles WHERE iri IS NOT NULL AND label <> '' GROUP BY iri",
    "tgt_ents": "SELECT iri, min(label) AS label FROM tgt_profiles WHERE iri IS NOT NULL AND label <> '' GROUP BY iri",
    "edges0": "SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier",
    "edges": "SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders",
    "nodes": "SELECT 'r' || r_regionkey AS iri, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier",
    "vpairs": "SELECT x.vec_id AS i, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0",
}


def sql(body: str, *views: str) -> str:
    """`body` after the named views."""
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + " " + body
