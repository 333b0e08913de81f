"""Cutting lineage with written tables.

Intermediate results that are read several times, or that end one round of an iterative algorithm,
are written as Parquet below the folder that all executors share (`spark.checkpoint.dir`), so a lost
executor costs a re-read and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[int, tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session. Where none is set a temporary one is made if all tasks run in this
    process (master local or local[...]); on a cluster, whose machines would not see it, that is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = got.get() if got.isDefined() else None
    if not set_dir:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def _path(spark: SparkSession, url: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(url)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _root(spark: SparkSession) -> str:
    key = id(spark.sparkContext)
    if key not in _ROOTS:
        root = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
        _ROOTS[key] = (root, spark)
        atexit.register(remove, spark, root)
    return _ROOTS[key][0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, deleted with everything else written here when the process ends."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, url: str) -> None:
    """Delete a folder written here; a session that is already gone is no error."""
    try:
        fs, p = _path(spark, url)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001
        pass


class Written:
    """A written intermediate table: `.df` reads it, `.drop()` deletes its files."""

    def __init__(self, spark: SparkSession, url: str, df: DataFrame):
        self.spark, self.url, self.df = spark, url, df

    def drop(self) -> None:
        remove(self.spark, self.url)


def write_table(df: DataFrame, name: str = "t") -> Written:
    """Write `df` into the shared folder and return a handle that reads it."""
    spark = df.sparkSession
    url = scratch(spark, name)
    df.write.parquet(url)
    return Written(spark, url, spark.read.schema(df.schema).parquet(url))


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """`df` computed once; the result reads the written table."""
    return write_table(df, name).df


def ready(spark: SparkSession, url: str) -> bool:
    """Whether a finished table is at `url` (its success marker exists)."""
    fs, p = _path(spark, url.rstrip("/") + "/_SUCCESS")
    return bool(fs.exists(p))


def reuse_or_write(spark: SparkSession, url: str, build, force: bool = False) -> DataFrame:
    """Resumable stage: read `url` if a finished table is there and `force` is off, else build and write it."""
    if force or not ready(spark, url):
        build().write.mode("overwrite").parquet(url)
    return spark.read.parquet(url)
