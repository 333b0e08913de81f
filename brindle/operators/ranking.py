"""Ranks, margins, empirical distributions and score prefixes as window expressions.

Ties: row numbers break them by identifier, `rank` shares the smallest, percent ranks average them.
Orders without a natural group are cumulated over range partitions of the distinct values, so that no
task has to hold a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.running import running


def both_row_numbers(df: DataFrame, score: str = "score") -> DataFrame:
    """With src_rank and tgt_rank: 1 for the best row of a source and of a target, ties by the other identifier."""
    s = Window.partitionBy("src_iri").orderBy(F.desc(score), F.asc("tgt_iri"))
    t = Window.partitionBy("tgt_iri").orderBy(F.desc(score), F.asc("src_iri"))
    return df.withColumn("src_rank", F.row_number().over(s)).withColumn("tgt_rank", F.row_number().over(t))


def both_ranks(df: DataFrame, score: str, where: Column | None = None) -> DataFrame:
    """With rank_src_tgt and rank_tgt_src (shared smallest rank); null for rows that `where` leaves out of the ranking."""
    keep = where if where is not None else F.lit(True)
    s = Window.partitionBy("src_iri", "_in").orderBy(F.desc_nulls_last(score))
    t = Window.partitionBy("tgt_iri", "_in").orderBy(F.desc_nulls_last(score))
    d = df.withColumn("_in", F.coalesce(keep, F.lit(False)))
    d = d.withColumn("rank_src_tgt", F.when(F.col("_in"), F.rank().over(s))).withColumn("rank_tgt_src", F.when(F.col("_in"), F.rank().over(t)))
    return d.drop("_in")


def gap_from_best(df: DataFrame, group: str, score: str) -> Column:
    """Best score of the group minus the row's."""
    return F.max(score).over(Window.partitionBy(group)) - F.col(score)


def pct_rank_long(long: DataFrame, name: str = "r") -> DataFrame:
    """`long` (.., feature, value) with the average-tie percent rank of each value within its feature, null values lowest.

    Distinct values are counted and the counts cumulated over range partitions, so no feature's rows meet in one task.
    """
    v = F.col("value").cast("double")
    steps = long.groupBy("feature", v.alias("value")).agg(F.count(F.lit(1)).alias("c"))
    upto = running(steps, [F.asc("feature"), F.asc_nulls_first("value")], sums={"upto": F.col("c")})
    whole = upto.groupBy(F.col("feature").alias("f")).agg(F.min(F.col("upto") - F.col("c")).alias("start"), F.sum("c").alias("n"))  # a row per feature
    ranks = upto.join(F.broadcast(whole), F.col("feature") == F.col("f"))
    ranks = ranks.select("f", F.col("value").alias("x"), ((F.col("upto") - F.col("start") - (F.col("c") - 1) / 2) / F.col("n")).alias(name))
    return long.join(ranks, (F.col("feature") == F.col("f")) & v.eqNullSafe(F.col("x"))).drop("f", "x")


def pct_ranks(df: DataFrame, key: Sequence[str], columns: Sequence[str], prefix: str = "rank__") -> DataFrame:
    """`key` with one percent-rank column for each of `columns`: unpivoted, ranked by column, pivoted back."""
    base = df.select(*key, *[F.col(c).cast("double").alias(c) for c in columns])
    ranked = pct_rank_long(base.unpivot(list(key), list(columns), "feature", "value"))
    return ranked.groupBy(*key).pivot("feature", list(columns)).agg(F.max("r")).withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def ecdf(values: DataFrame, value: str, reference: DataFrame, ref_value: str, name: str = "cdf") -> DataFrame:
    """`values` with the share of reference values at or below each value; null for null, 0 without a reference.

    The reference is counted by distinct value and cumulated over range partitions; values meet it by distinct value too.
    """
    v = values.select(F.col(value).alias("x")).filter("x IS NOT NULL").distinct().withColumn("c", F.lit(0).cast("bigint"))
    r = reference.select(F.col(ref_value).alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    n = r.agg(F.sum("c")).first()[0] or 0
    steps = v.unionByName(r).groupBy("x").agg(F.sum("c").alias("c"))
    table = running(steps, [F.asc("x")], sums={"upto": F.col("c")}).select(F.col("x").alias(value), (F.col("upto") / F.lit(float(max(n, 1)))).alias(name))
    return values.join(table, value, "left")


def ecdf_long(long: DataFrame, reference: DataFrame, name: str = "cdf") -> DataFrame:
    """`long` (.., feature, value) with the share of the feature's `reference` (feature, value) values at or below its own; values are numbers."""
    v = F.col("value").cast("double")
    own = long.select("feature", v.alias("value")).distinct().withColumn("c", F.lit(0).cast("bigint"))
    ref = reference.groupBy("feature", v.alias("value")).agg(F.count(F.lit(1)).alias("c"))
    steps = own.unionByName(ref).groupBy("feature", "value").agg(F.sum("c").alias("c"))
    upto = running(steps, [F.asc("feature"), F.asc_nulls_first("value")], sums={"upto": F.col("c")})
    whole = upto.groupBy(F.col("feature").alias("f")).agg(F.min(F.col("upto") - F.col("c")).alias("start"), F.sum("c").alias("n"))  # a row per feature
    cdf = upto.join(F.broadcast(whole), F.col("feature") == F.col("f")).select("f", F.col("value").alias("x"), ((F.col("upto") - F.col("start")) / F.greatest("n", F.lit(1))).alias(name))
    return long.join(cdf, (F.col("feature") == F.col("f")) & v.eqNullSafe(F.col("x"))).drop("f", "x")


def best_prefix(df: DataFrame, score: str, label: str, gold_total: int, descending: bool = True) -> DataFrame:
    """One row: the score threshold with the best F1 over all prefixes of the score order, equal scores together."""
    g = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(label).cast("bigint")).alias("p"))
    g = running(g, [F.desc("threshold") if descending else F.asc("threshold")], sums={"n": F.col("c"), "tp": F.col("p")})
    g = g.withColumn("precision", F.col("tp") / F.col("n")).withColumn("recall", F.col("tp") / F.lit(float(max(gold_total, 1))))
    g = g.withColumn("f1", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("n") + F.lit(gold_total))).otherwise(F.lit(0.0)))
    return g.orderBy(F.desc("f1"), F.desc("threshold") if descending else F.asc("threshold")).limit(1).select("threshold", "n", "tp", "precision", "recall", "f1")


def rank_features(df: DataFrame, rank: str, group: str, prefix: str) -> DataFrame:
    """Group size, rank percentile, reciprocal rank and log rank of a rank column."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    r = F.col(rank)
    return df.withColumn(f"{prefix}_group_size", n).withColumn(f"{prefix}_percentile", F.when(n > 1, (r - 1) / (n - 1)).otherwise(F.lit(0.0))).withColumn(f"{prefix}_reciprocal", 1.0 / r).withColumn(f"{prefix}_log", F.log1p(r))


def group_margin(df: DataFrame, group: str, score: str) -> DataFrame:
    """(group, margin): best minus second-best distinct score; the best itself where there is no second."""
    d = df.select(group, score).distinct().withColumn("r", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc(score)))).filter("r <= 2")
    return d.groupBy(group).agg((F.max(F.when(F.col("r") == 1, F.col(score))) - F.coalesce(F.max(F.when(F.col("r") == 2, F.col(score))), F.lit(0.0))).alias("margin"))


def best_with_second(df: DataFrame, score: str = "score") -> DataFrame:
    """The best row of each source with the second score (0 without) and the margin."""
    w = Window.partitionBy("src_iri").orderBy(F.desc(score), F.asc("tgt_iri"))
    d = df.withColumn("second", F.coalesce(F.lead(score).over(w), F.lit(0.0))).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return d.withColumn("margin", F.col(score) - F.col("second"))


def nth_best(df: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """(group, value): the n-th best score, 0 where there are fewer."""
    r = df.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score))))
    return r.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("r") == n, F.col(score))), F.lit(0.0)).alias("value"))


def bidirectional_features(df: DataFrame, constant: float = 10.0) -> DataFrame:
    """min/max/difference of rank_src_tgt and rank_tgt_src, reciprocal rank fusion, mutual top 1, 5 and 10; absent ranks give nulls and 0."""
    a, b = F.col("rank_src_tgt"), F.col("rank_tgt_src")
    out = df.withColumn("rank_min", F.least(a, b)).withColumn("rank_max", F.greatest(a, b)).withColumn("rank_diff", F.abs(a - b)).withColumn("rrf", 1.0 / (constant + a) + 1.0 / (constant + b))
    for k in (1, 5, 10):
        out = out.withColumn(f"mutual_top{k}", F.coalesce(((a <= k) & (b <= k)).cast("int"), F.lit(0)))
    return out


def rank_rule(rule: str, k: int) -> Column:
    """none, or, and: both or one of the ranks at most k; an absent rank is above any."""
    holds = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    if rule == "none":
        return F.lit(True)
    return holds("rank_src_tgt") & holds("rank_tgt_src") if rule == "and" else holds("rank_src_tgt") | holds("rank_tgt_src")


def correct_ranks(df: DataFrame, score: str, label: str, query: str = "src_iri", item: str = "tgt_iri") -> DataFrame:
    """(query, rank): rank of the first right item of each query; 0 where none is right."""
    r = df.withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))))
    return r.groupBy(query).agg(F.coalesce(F.min(F.when(F.col(label) == 1, F.col("r"))), F.lit(0)).alias("rank"))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by `order`."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def ordered_union(limit: int, *lists: Column) -> Column:
    """Elements of several arrays, first seen first, at most `limit`."""
    return F.slice(F.array_distinct(F.concat(*lists)), 1, limit)
