"""Mapping and score tables in TSV, CSV and JSON: readers with column aliases, and writers."""

from __future__ import annotations

import glob
import io
import json
import os
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.ranking import keep_first

# Names under which the two sides and the score occur.
ALIASES = {
    "src_iri": ("srcentity", "srciri", "source", "src", "entity1"),
    "tgt_iri": ("tgtentity", "tgtiri", "target", "tgt", "entity2"),
    "score": ("score", "oofscore", "probability", "prediction", "confidence", "modelscore"),
}


def separator(path: str) -> str:
    return "," if path.lower().removesuffix(".gz").endswith(".csv") else "\t"


def rename_columns(df: DataFrame, positional: bool = False, required: Sequence[str] = ("src_iri", "tgt_iri")) -> DataFrame:
    """Columns renamed by ALIASES, compared without case and underscores; `positional` takes the first two as sides."""
    plain = {c.lower().replace("_", "").replace(" ", ""): c for c in reversed(df.columns)}
    new: dict[str, str] = {}
    for name, others in ALIASES.items():
        got = next((plain[o] for o in (name.replace("_", ""), *others) if o in plain), None)
        if got:
            new[got] = name
    if positional and len(df.columns) >= 2:
        new = {df.columns[0]: "src_iri", df.columns[1]: "tgt_iri"} | {k: v for k, v in new.items() if v == "score"}
    missing = set(required) - set(new.values())
    if missing:
        raise ValueError(f"no column for {sorted(missing)} in {df.columns}")
    return df.withColumnsRenamed(new)


def read_table(spark: SparkSession, path: str, positional: bool = False) -> DataFrame:
    """A delimited file as strings, renamed."""
    return rename_columns(spark.read.csv(path, sep=separator(path), header=True), positional)


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(src_iri, tgt_iri[, score]): distinct pairs with both sides; the score is a number or null."""
    df = read_table(spark, path).filter("src_iri IS NOT NULL AND tgt_iri IS NOT NULL")
    if "score" in df.columns:
        df = df.withColumn("score", F.col("score").try_cast("double"))
        return keep_first(df.select("src_iri", "tgt_iri", "score"), ["src_iri", "tgt_iri"], [F.desc_nulls_last("score")])
    return df.select("src_iri", "tgt_iri").distinct()


def parse_candidates(df: DataFrame, column: str = "TgtCandidates") -> DataFrame:
    """With tgt_candidates, the quoted entries of a tuple written as text (empty where there is none), and n_candidates."""
    got = F.coalesce(F.regexp_extract_all(F.col(column), F.lit("'([^']*)'|\"([^\"]*)\""), F.lit(0)), F.expr("CAST(array() AS array<string>)"))
    return df.withColumn("tgt_candidates", F.transform(got, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))).withColumn("n_candidates", F.size("tgt_candidates"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return parse_candidates(spark.read.csv(path, sep="\t", header=True))


def read_task(spark: SparkSession, folder: str, task: str = "equiv") -> dict[str, DataFrame]:
    """train, valid, test and candidates of a task folder, those that exist."""
    base = os.path.join(folder, f"refs_{task}")
    out = {n: read_mappings(spark, p) for n in ("train", "valid", "test") if os.path.exists(p := os.path.join(base, f"{n}.tsv"))}
    if os.path.exists(p := os.path.join(base, "test.cands.tsv")):
        out["candidates"] = read_candidates(spark, p)
    return out


def scores(df: DataFrame) -> DataFrame:
    """(src_iri, tgt_iri, score): the highest number of each pair; what is no number counts as 0."""
    d = rename_columns(df, required=("src_iri", "tgt_iri", "score"))
    return d.groupBy("src_iri", "tgt_iri").agg(F.max(F.coalesce(F.nanvl(F.col("score").try_cast("double"), F.lit(0.0)), F.lit(0.0))).alias("score"))


def predictions(df: DataFrame, order: str) -> DataFrame:
    """(src_iri, tgt_iri, score): the first row of each pair by `order`, those without a number left out."""
    d = rename_columns(df, required=("src_iri", "tgt_iri", "score"))
    d = keep_first(d.withColumn("score", F.col("score").try_cast("double")), ["src_iri", "tgt_iri"], [F.asc(order)])
    return d.filter(F.col("score").isNotNull() & ~F.isnan("score")).select("src_iri", "tgt_iri", "score")


def feature_matrix(df: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Pair keys and numeric columns, unusable numbers as 0; checks the number of rows."""
    from brindle.operators.pairs import numeric_columns, scrub

    names = numeric_columns(df)
    if expected_rows is not None and (n := df.count()) != expected_rows:
        raise ValueError(f"{n} rows, expected {expected_rows}")
    return scrub(df.select("src_iri", "tgt_iri", *names), names)


def deep_features(df: DataFrame, pairs: DataFrame, boundary: str = "label", left_out: str = "gold_support_") -> DataFrame:
    """`pairs` with the numeric columns after `boundary`, prefixed deep__; fails where a pair has no features at all."""
    from brindle.operators.pairs import numeric_columns, one_to_one_left_join

    names = numeric_columns(df, after=boundary, without=left_out)
    j = one_to_one_left_join(pairs, df.select("src_iri", "tgt_iri", *[F.col(c).alias(f"deep__{c}") for c in names]))
    empty = F.greatest(*[F.col(f"deep__{c}").isNotNull() for c in names]) if len(names) > 1 else F.col(f"deep__{names[0]}").isNotNull()
    if not j.filter(~empty).isEmpty():
        raise ValueError("pairs without features")
    return j


def read_zip_csv(spark: SparkSession, path: str, member: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV member of a ZIP as strings: copied once, as a stream, into the shared folder and read as an ordinary,
    splittable, pruned CSV scan. The ZIP and the folder may be on any file system Spark knows. A member that
    isn't there raises KeyError."""
    from brindle.sources.materialize import scratch

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    packed = jvm.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
    try:
        entry = packed.getNextEntry()
        while entry is not None and entry.getName() != member:
            entry = packed.getNextEntry()
        if entry is None:
            raise KeyError(f"no {member} in {path}")
        url = f"{scratch(spark, 'zip')}/{os.path.basename(member)}"
        target = jvm.org.apache.hadoop.fs.Path(url)
        out = target.getFileSystem(conf).create(target)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(packed, out, conf, False)
        out.close()
    finally:
        packed.close()
    df = spark.read.csv(url, header=True)
    return df.select(*columns) if columns else df


def zip_header(path: str, member: str) -> list[str]:
    with zipfile.ZipFile(path) as z, z.open(member) as f:
        return io.TextIOWrapper(f, "utf-8").readline().rstrip("\r\n").split(",")


def write_tsv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """Tab-separated text with a header. `one_file` is for results of bounded size, such as a submission."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_json(rows: dict, path: str) -> None:
    """A report, published by renaming a finished file."""
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        json.dump(rows, f, indent=1, sort_keys=True, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def package(folders: dict[str, str], path: str) -> list[str]:
    """Text results, by the name they get, in one ZIP that is tested; returns its members."""
    tmp = f"{path}.tmp"
    with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
        for name, folder in folders.items():
            with z.open(name, "w") as out:
                for i, part in enumerate(sorted(glob.glob(os.path.join(folder, "part-*")))):
                    with open(part, "rb") as f:
                        head = f.readline()
                        if i == 0:
                            out.write(head)
                        out.write(f.read())
    with zipfile.ZipFile(tmp) as z:
        if z.testzip() is not None:
            raise ValueError("damaged package")
        names = z.namelist()
    os.replace(tmp, path)
    return names
