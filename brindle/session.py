"""Session defaults. Everything here can be overridden by the caller's own configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE re-plans joins, coalesces partitions and splits skewed ones at run time; timestamps are compared in UTC.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(app: str = "brindle", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` keys use `__` for `.`. On a cluster leave master and partitions to spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
