"""Parquet table access by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table `name` below `base` (one file or a folder of parts)."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
