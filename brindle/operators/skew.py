"""Joins that stay balanced when one key holds a large share of all rows.

A key is hot with more than 1/SHARE of all rows, or with more than CEILING rows however large the table is.
There can be at most max(SHARE, rows / CEILING) hot keys, so the list of hot keys stays a few megabytes up to
10^12 rows and may be sent to every task, and no task holds more than about CEILING rows of one key. Rows of a
hot key are spread over as many salts as it has shares; the other side repeats its (few) rows of that key
once for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1000
#: Keys with fewer rows than this are never worth splitting.
LEAST_ROWS = 20_000
#: No key with more rows than this stays in one task.
CEILING = 2_000_000


def hot_limit(total: int, share: int = SHARE, least: int = LEAST_ROWS, ceiling: int = CEILING) -> int:
    """The most rows a key may have without being hot, of a table of `total` rows."""
    return int(min(max(total / share, least), max(ceiling, 1)))


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: int = SHARE, least: int = LEAST_ROWS, total: int | None = None, ceiling: int = CEILING) -> DataFrame:
    """Of per-key row counts, the hot keys with the number of salts each gets: at most max(share, total / ceiling) rows.

    Null keys are never hot. An empty input gives an empty table. `total`, the sum of the counts, saves
    a job where it is known.
    """
    spark = counts.sparkSession
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    limit = hot_limit(total, share, least, ceiling)
    rows = [] if total <= limit else counts.filter((F.col(n) > limit) & F.col(key).isNotNull()).select(key, F.ceil(F.col(n) / limit).cast("int").alias("salts")).collect()
    schema = f"`{key}` {dict(counts.dtypes)[key]}, salts int"
    return spark.createDataFrame([(r[0], r[1]) for r in rows], schema)


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """`big` joined to `small` (few rows per key) on `key`, hot keys spread by `spread`.

    `how` is inner, left, left_semi or left_anti, seen from `big`. `spread` must be a deterministic
    expression over `big`'s columns, so that a task that runs again gives its rows the same salts.
    """
    hot_b = F.broadcast(hot)
    left = big.join(hot_b, key, "left").withColumn("_salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("salts")).cast("int"))).drop("salts")
    right = small.join(hot_b, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def crossed_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread_left: Column, spread_right: Column) -> DataFrame:
    """Inner join of two sides that may both have many rows of one key. `hot` has (key, a, b): the key's left rows are
    dealt into a parts and its right rows into b, and each left part meets each right part in a task of its own."""
    hot_b = F.broadcast(hot)

    def dealt(df: DataFrame, spread: Column, own: str, other: str) -> DataFrame:
        d = df.join(hot_b, key, "left")
        d = d.withColumn(f"_{own}", F.when(F.col(own).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col(own)).cast("int")))
        return d.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))).drop("a", "b")

    return dealt(left, spread_left, "a", "b").join(dealt(right, spread_right, "b", "a"), [key, "_a", "_b"]).drop("_a", "_b")
