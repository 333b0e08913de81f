"""One ranking from several differently-scaled scores: median rank aggregation.

Within a group every item gets its rank in each score, the weighted median of its ranks, and a place
in the order of (median rank, mean rank, identifier). Only ranks count, so no score's range matters.

Groups of ordinary size are ranked by windows that share one shuffle. A hot group, of which there are
at most a fixed number, is never sorted in one task: its values are cut at approximate quantiles, a row's
rank is the number of rows in higher cuts plus its rank inside its own, and values that are quantiles
themselves (so also every value that very many rows share) need no sort at all. The final order of
hot groups comes from a range-partitioned sort with per-partition offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.skew import LEAST_ROWS, hot_keys
from brindle.sources.materialize import write_table

CUTS = 64
#: Rows of one group that one task folds or checks at a time.
CHUNK = 50_000


def _ranks_by_window(rows: DataFrame, scores: Sequence[str]) -> DataFrame:
    out = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    for s in scores:
        w = Window.partitionBy("g").orderBy(F.col(s).desc_nulls_last())
        out = out.withColumn(f"rank_{s}", F.rank().over(w).cast("bigint"))
    return out


def _greater_than(v: Column):
    return lambda x: x > v


def _ranks_by_cuts(rows: DataFrame, scores: Sequence[str], counts: DataFrame) -> DataFrame:
    """As _ranks_by_window for hot groups. All broadcast tables have at most hot groups x (2 CUTS + 3) rows."""
    points = ",".join(str(i / CUTS) for i in range(CUTS + 1))
    cuts = rows.groupBy("g").agg(*[F.array_distinct(F.expr(f"percentile_approx({s}, array({points}), 10000)")).alias(f"cuts_{s}") for s in scores])
    out = rows.join(F.broadcast(counts), "g").join(F.broadcast(cuts), "g")
    for s in scores:
        v, c = F.col(s), F.coalesce(F.col(f"cuts_{s}"), F.expr("CAST(array() AS array<double>)"))
        above = F.size(F.filter(c, _greater_than(v)))
        out = out.withColumn("b", F.when(v.isNull(), F.lit(2 * CUTS + 9)).otherwise(2 * above + F.array_contains(c, v).cast("int")))
        flat = v.isNull() | F.array_contains(c, v)  # all rows of this cut share one value
        sizes = out.groupBy("g", "b").agg(F.count(F.lit(1)).alias("in_b"))
        sizes = sizes.withColumn("before", F.sum("in_b").over(Window.partitionBy("g").orderBy("b")) - F.col("in_b"))
        out = out.withColumn("flat", flat).withColumn("spread", F.when(F.col("flat"), F.pmod(F.xxhash64("i"), F.lit(CUTS))).otherwise(F.lit(0)))
        out = out.join(F.broadcast(sizes), ["g", "b"])
        w = Window.partitionBy("g", "b", "spread").orderBy(v.desc_nulls_last())
        out = out.withColumn(f"rank_{s}", F.col("before") + F.when(F.col("flat"), F.lit(1)).otherwise(F.rank().over(w)))
        out = out.drop("b", "flat", "spread", "in_b", "before", f"cuts_{s}")
    return out


def _weighted_median(ranks: Sequence[Column], weights: Sequence[float]) -> Column:
    """The smallest rank at which half of the weight is reached."""
    ordered = F.array_sort(F.array(*[F.struct(r.alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights)]))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("bigint").alias("r"))
    half = sum(weights) / 2
    return F.aggregate(ordered, start, lambda a, x: F.struct((a["w"] + x["w"]).alias("w"), F.when(a["r"].isNull() & (a["w"] + x["w"] >= half), x["r"]).otherwise(a["r"]).alias("r")), lambda a: a["r"])


def _place_hot(rows: DataFrame) -> DataFrame:
    """`place` of hot groups: a range-partitioned sort, written once, and offsets per partition."""
    order = ["g", "median_rank", "mean_rank", "i"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = write_table(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "median-hot").df
    at = at.withColumn("part", F.shiftright("at", 33))
    first = at.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    first = first.withColumn("before", F.sum("c").over(Window.partitionBy("g").orderBy("part")) - F.col("c")).drop("c")
    return at.join(F.broadcast(first), ["g", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1).drop("at", "part", "first", "before")


def rank_items(rows: DataFrame, group: str, item: str, scores: Sequence[str], weights: Sequence[float] | None = None, hot_from: int = LEAST_ROWS) -> DataFrame:
    """Per (group, item): the scores, n (items in the group), rank_S (1 + items strictly above), median_rank,
    mean_rank and place (1..n, unique).

    An item given several times counts once, with the highest of each score. A null or NaN score ranks
    below every given one and ties with the other missing ones. Rows with a null group or item take no
    part; other columns are ignored; an empty table gives an empty one. A group of more than
    max(rows/1000, hot_from) items is ranked by cuts instead of windows, with the same result.
    """
    weights = list(weights or [1.0] * len(scores))
    names = dict(zip([f"s{k}" for k in range(len(scores))], scores))
    given = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), *[F.col(s).cast("double").alias(k) for k, s in names.items()]).filter("g IS NOT NULL AND i IS NOT NULL")
    clean = [F.max(F.when(~F.isnan(k), F.col(k))).alias(k) for k in names]
    base = write_table(given.groupBy("g", "i").agg(*clean), "median-rows").df
    scores = list(names)
    counts = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "g", least=hot_from)
    parts = [_ranks_by_window(base.join(F.broadcast(hot.select("g")), "g", "left_anti"), scores)]
    if not hot.isEmpty():
        of_hot = base.join(F.broadcast(hot.select("g")), "g", "left_semi")
        parts.append(_ranks_by_cuts(of_hot, scores, of_hot.groupBy("g").agg(F.count(F.lit(1)).alias("n"))))
    out = []
    for k, ranked in enumerate(parts):
        ranks = [F.col(f"rank_{s}") for s in scores]
        mean = sum((r * float(w) for r, w in zip(ranks, weights)), F.lit(0.0)) / sum(weights)
        ranked = ranked.withColumn("median_rank", _weighted_median(ranks, weights)).withColumn("mean_rank", mean)
        if k:
            ranked = _place_hot(ranked)
        else:
            ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("median_rank", "mean_rank", "i")).cast("bigint"))
        out.append(ranked.select("g", "i", *scores, "n", *[f"rank_{s}" for s in scores], "median_rank", "mean_rank", "place"))
    both = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    back = {"g": group, "i": item} | names | {f"rank_{k}": f"rank_{s}" for k, s in names.items()}
    return both.withColumnsRenamed(back)


def _wins(a: str, b: str, scores: Sequence[str]) -> Column:
    """On how many scores struct `a` is strictly above struct `b`; a missing score is below any given one."""
    one = [F.when(F.expr(f"{a}.{s} IS NOT NULL AND ({b}.{s} IS NULL OR {a}.{s} > {b}.{s})"), 1).otherwise(0) for s in scores]
    return sum(one[1:], one[0])


def majority_winners(ranked: DataFrame, group: str, item: str, scores: Sequence[str], least_items: int = 1) -> DataFrame:
    """(group, item): of rank_items' output, the item strictly above each other item of its group on more
    than half of the scores, where there is one, in groups of at least `least_items` items.

    The (unweighted) median and mean ranks rule items out first: each of the n - 1 others can be above a
    winner on `spare` scores at most, so its ranks minus 1 add up to spare (n - 1) at most, which bounds its mean
    rank, and its median rank too, since the ranks from the median on are no smaller. What is left plays
    knock-out in chunks of CHUNK rows (a winner survives any order of play), and the survivor is checked
    against every row of its group.
    """
    need = len(scores) // 2 + 1
    spare = len(scores) - need  # scores on which one opponent may be at or above
    others = spare * (F.col("n") - 1)
    from_median = len(scores) - -(-len(scores) // 2) + 1  # ranks that are the median or follow it
    possible = ((F.col("median_rank") - 1) * from_median <= others) & ((F.col("mean_rank") - 1) * len(scores) <= others + 1e-6 * F.col("n"))
    vec = F.struct(F.col(item).alias("i"), *scores)
    rows = ranked.filter(F.col("n") >= least_items).select(F.col(group).alias("g"), vec.alias("x"), "n", possible.alias("possible"))
    left = rows.filter("possible").select("g", "x", F.greatest(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int").alias("salts"))

    def duel(a, b):
        def wins(p, q):
            one = [F.when(p[s].isNotNull() & (q[s].isNull() | (p[s] > q[s])), 1).otherwise(0) for s in scores]
            return sum(one[1:], one[0])

        none = F.lit(None).cast(left.schema["x"].dataType)
        return F.when(a.isNull(), b).when(wins(a, b) >= need, a).when(wins(b, a) >= need, b).otherwise(none)

    def play(df: DataFrame, *by) -> DataFrame:
        start = F.lit(None).cast(left.schema["x"].dataType)
        return df.groupBy(*by).agg(F.collect_list("x").alias("xs"), F.max("salts").alias("salts")).select("g", F.aggregate("xs", start, duel).alias("x"), "salts").filter("x IS NOT NULL")

    first = play(left.withColumn("salt", F.pmod(F.xxhash64("x.i"), F.col("salts"))), "g", "salt")
    last = play(first, "g").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("g", "salt", F.col("x").alias("w"))
    all_rows = rows.withColumn("salt", F.pmod(F.xxhash64("x.i"), F.greatest(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int")).cast("int"))
    # the survivors are the small side, built group by group: the planner, misled by pruned files, would send all rows to every task
    check = all_rows.join(last.hint("shuffle_hash"), ["g", "salt"]).groupBy("g", F.col("w.i").alias("i")).agg(F.max("n").alias("n"), F.sum(F.when(_wins("w", "x", scores) >= need, 1).otherwise(0)).alias("beaten"))
    return check.filter(F.col("beaten") == F.col("n") - 1).select(F.col("g").alias(group), F.col("i").alias(item))
