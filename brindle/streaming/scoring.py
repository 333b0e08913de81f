"""Incremental scoring (an extension): arriving candidate pairs are scored and matched batch by batch.

Deduplication of pairs is bounded by a watermark; every micro-batch is written under its own id, so a batch that
runs again replaces itself and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def pair_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fresh_pairs(stream: DataFrame, time: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """Pairs seen for the first time within the watermark."""
    return stream.filter("src_iri IS NOT NULL AND tgt_iri IS NOT NULL").withWatermark(time, late).dropDuplicatesWithinWatermark(["src_iri", "tgt_iri"])


def arrivals(stream: DataFrame, time: str = "loaded_at", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, n, mean_score) by window of arrival."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(F.nanvl("sapbert_cosine", F.lit(None).cast("double"))).alias("mean_score")).select(F.col("window.start").alias("start"), "n", "mean_score")


def score_batches(stream: DataFrame, score, out: str, checkpoint: str) -> StreamingQuery:
    """`score`, a function of a batch, applied to everything that is there; results go to out/batch=<id>."""

    def write(df: DataFrame, batch: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
