"""Running totals over one global order, without a window that holds the table in one task.

The rows are range-partitioned and sorted once into a written table; every part's totals, of which there
are as many as partitions, are cumulated and added to running totals within the parts. Rows that
share a place in the order are aggregated before, so a very common value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.materialize import write_table


def in_parts(df: DataFrame, order: Sequence[Column], parts: int | None = None, name: str = "ranged") -> DataFrame:
    """`df` in a written table with `_part`: consecutive ranges of the order, numbered in it."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return write_table(ranged.withColumn("_part", F.spark_partition_id()), name).df


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """`df` with, for every entry of `sums` (`mins`), the total (least value) of that expression over all rows up
    to and with the row in the order. The order must be total: no two rows may share their place.

    Null values add nothing; an empty table gives an empty one.
    """
    sums, mins = sums or {}, mins or {}
    at = in_parts(df.withColumns({**{f"_v_{k}": c for k, c in {**sums, **mins}.items()}}), order, parts)
    whole = at.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_o_{k}") for k in sums], *[F.min(f"_v_{k}").alias(f"_o_{k}") for k in mins])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = whole.select("_part", *[F.sum(f"_o_{k}").over(before).alias(f"_o_{k}") for k in sums], *[F.min(f"_o_{k}").over(before).alias(f"_o_{k}") for k in mins])
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = at.join(F.broadcast(offsets), "_part")
    zero = F.lit(0)
    out = out.withColumns({**{k: F.coalesce(F.sum(f"_v_{k}").over(upto), zero) + F.coalesce(F.col(f"_o_{k}"), zero) for k in sums}, **{k: F.least(F.min(f"_v_{k}").over(upto), F.col(f"_o_{k}")) for k in mins}})
    return out.drop("_part", *[f"_{x}_{k}" for k in (*sums, *mins) for x in ("v", "o")])
