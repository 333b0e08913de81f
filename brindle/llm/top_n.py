"""Top N items within every group.

No group is ever sorted. All groups are bisected at once: a row carries an order-preserving integer
code, each round cuts the undecided code interval of every group into STEPS parts, counts the rows in
each part (pre-aggregated before the shuffle), keeps the parts that lie wholly above the cutoff and
goes on in the one part that holds it, until each group holds exactly N rows. Rows of equal score are
bisected further by their identifier, five bytes a round. A group's rows are spread over salts when
it is hot; per group only counts of STEPS parts ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.skew import hot_keys
from brindle.sources.materialize import write_table

STEPS = 256
_TAIL = 15  # hexadecimal digits of an identifier read in one round: five bytes with a marker each


def score_code(score: Column) -> Column:
    """A bigint that orders as the double does; -0.0 and 0.0 share one."""
    plain = F.when(score == 0, F.lit(0.0)).otherwise(score)
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(F.bitwise_not(bits).bitwiseXOR(F.lit(-(2**63))))


def _marked(item: Column) -> Column:
    """The identifier's bytes in hexadecimal, each led by a marker, so that a prefix sorts first."""
    return F.regexp_replace(F.hex(F.encode(item, "UTF-8")), "(..)", "1$1")


def _common(lo: Column, hi: Column) -> Column:
    """Length of the common prefix of two marked identifiers."""
    n = F.least(F.length(lo), F.length(hi))
    same = F.filter(F.sequence(F.lit(1), n), lambda p: F.substring(lo, F.lit(1), p) == F.substring(hi, F.lit(1), p))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(same))


def _item_code(marked: Column, skip: Column) -> Column:
    """Larger for a smaller identifier: the digits after the prefix that all candidates share."""
    tail = F.rpad(F.substring(marked, skip + 1, F.lit(_TAIL)), _TAIL, "0")
    return -F.conv(tail, 16, 10).cast("bigint")


def _part() -> Column:
    """Which of STEPS equal parts of [lo, hi] holds `code`: exact, monotone, free of overflow."""
    return F.expr(
        f"CASE WHEN shiftright(hi, 1) - shiftright(lo, 1) >= {2**61} "
        f"THEN (shiftright(code, 1) - shiftright(lo, 1)) div ((shiftright(hi, 1) - shiftright(lo, 1)) div {STEPS} + 1) "
        f"ELSE (code - lo) div ((hi - lo) div {STEPS} + 1) END"
    )


def _round(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """One cut of every group: the rows that stay, with `taken` and what their group still needs."""

    def spread(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), "g", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    stats = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("sc").alias("slo"), F.max("sc").alias("shi"), F.min("i").alias("ilo"), F.max("i").alias("ihi"), F.max("need").alias("need"))
    tied = F.col("slo") == F.col("shi")
    mlo, mhi = _marked(F.col("ilo")), _marked(F.col("ihi"))
    stats = stats.withColumn("skip", F.when(tied & (F.col("n") > F.col("need")), _common(mlo, mhi)))
    stats = stats.withColumn("lo", F.when(F.col("skip").isNull(), F.col("slo")).otherwise(_item_code(mhi, F.col("skip"))))
    stats = stats.withColumn("hi", F.when(F.col("skip").isNull(), F.col("shi")).otherwise(_item_code(mlo, F.col("skip"))))
    known = rows.drop("need").join(spread(stats.select("g", "n", "need", "skip", "lo", "hi")), ["g", "salt"])
    known = known.withColumn("code", F.when(F.col("skip").isNull(), F.col("sc")).otherwise(_item_code(_marked(F.col("i")), F.col("skip"))))
    known = known.withColumn("part", _part())
    counts = known.groupBy("g", "part").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"))
    upto = Window.partitionBy("g").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = counts.withColumn("cum", F.sum("c").over(upto)).filter((F.col("cum") - F.col("c") < F.col("need")))
    cuts = cuts.groupBy("g").agg(F.min("part").alias("cut"), F.max("cum").alias("cum"), F.max_by("c", "cum").alias("c"), F.max("need").alias("need"))
    cuts = cuts.select("g", "cut", (F.col("cum") <= F.col("need")).alias("exact"), (F.col("need") - F.col("cum") + F.col("c")).alias("left"))
    out = known.drop("need", "n", "skip", "lo", "hi", "code").join(spread(cuts), ["g", "salt"])
    out = out.filter(F.col("part") >= F.col("cut"))
    return out.select("g", "i", "s", "sc", "salt", ((F.col("part") > F.col("cut")) | F.col("exact")).alias("taken"), F.col("left").alias("need"))


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, rank): the n best items of every group, equal scores by identifier, by byte.

    A pair given several times counts once, with its highest score. Rows with a null group, a null
    item or a null or NaN score take no part; a group with fewer than n items gives them all; other
    columns are ignored; an empty table gives an empty one. `item` is a string column.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    given = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    given = given.filter(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    pairs = write_table(given.groupBy("g", "i").agg(F.max("s").alias("s")), "top-pairs")
    hot = hot_keys(pairs.df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    active = pairs.df.join(F.broadcast(hot), "g", "left").withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("i"), F.col("salts")).cast("int"))).drop("salts")
    active = active.withColumn("sc", score_code(F.col("s"))).withColumn("need", F.lit(n).cast("bigint"))
    taken = None
    while True:
        step = write_table(_round(active, hot), "top-round").df
        done = step.filter("taken").select("g", "i", "s")
        taken = done if taken is None else taken.unionByName(done)
        active = step.filter("NOT taken").drop("taken")
        if active.isEmpty():
            break
    pairs.drop()
    best = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))
    return taken.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.row_number().over(best).alias("rank"))
