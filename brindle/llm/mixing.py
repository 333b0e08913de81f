"""Mixing sources to target weights: cube-method balanced sampling.

A source's records are wanted r times on average, r = wanted size / its size, but at most its number of
repeats. Every record is taken floor(r) times; the fractional parts are sampled by the cube method,
balanced on two totals, the size and the number of records. The flight phase moves the probabilities
of three undecided records at a time along the null space of the two constraints until one is decided;
it runs in blocks of bounded size, the at most two records each block leaves undecided meet in the
next level, and the landing phase decides the at most two that a source has left in the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.materialize import write_table

BLOCK = 20_000
_EPS = 1e-9


def _step(p: list[float], u: tuple[float, ...], idx: list[int], rng: np.random.Generator) -> None:
    """Move the probabilities at idx along +u or -u, unbiased, until one of them is 0 or 1."""
    plus = min((((1 - p[i]) if d > 0 else p[i]) / abs(d)) for i, d in zip(idx, u) if d)
    minus = min(((p[i] if d > 0 else (1 - p[i])) / abs(d)) for i, d in zip(idx, u) if d)
    lam = plus if rng.random() < minus / (plus + minus) else -minus
    for i, d in zip(idx, u):
        x = p[i] + lam * d
        p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x


def flight(p: list[float], sizes: list[float], rng: np.random.Generator) -> list[float]:
    """The probabilities after the flight phase: at most two are neither 0 nor 1."""
    p = list(p)
    live: list[int] = []
    for k in range(len(p)):
        if 0 < p[k] < 1:
            live.append(k)
        while len(live) == 3:
            a, b, c = live
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            scale = max(abs(x) for x in u)
            if scale < 1e-12:  # equal sizes: the constraints are one
                u = (1.0, -1.0, 0.0)
            else:
                u = tuple(x / scale for x in u)
            _step(p, u, live, rng)
            live = [i for i in live if 0 < p[i] < 1]
    return p


def land(p: list[float], rng: np.random.Generator) -> list[float]:
    """What is left decided: the size constraint is dropped first, then the number."""
    p = list(p)
    live = [i for i, x in enumerate(p) if 0 < x < 1]
    while len(live) > 1:
        _step(p, (1.0, -1.0), live[:2], rng)
        live = [i for i in live if 0 < p[i] < 1]
    for i in live:
        p[i] = float(rng.random() < p[i])
    return p


def source_key(c: Column) -> Column:
    """Spellings of one source: lower case, runs of other characters than letters and digits one underscore."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ", "_")


def plan(records: DataFrame, source: str, size: str, targets: DataFrame, target_source: str, share: str, repeats: str) -> DataFrame:
    """(source, key, target_share, max_repeats, n_records, size, total, target, capacity, rate): what each target
    source has and how often its records are wanted. `source` is written as in `targets`. Totals take in
    records of every source, null ones too. Few rows: as many as targets. A repeated source counts once,
    with its highest share; a null share counts as 0 and null repeats as 1."""
    t = targets.filter(F.col(target_source).isNotNull()).groupBy(F.col(target_source).alias("source")).agg(F.max(F.coalesce(F.col(share), F.lit(0.0))).alias("target_share"), F.max(F.coalesce(F.col(repeats), F.lit(1))).alias("max_repeats"))
    have = records.groupBy(source_key(F.col(source)).alias("key")).agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.col(size)).cast("bigint").alias("size"))
    total = records.agg(F.sum(size)).first()[0] or 0
    out = t.withColumn("key", source_key(F.col("source"))).join(have, "key", "left").withColumn("total", F.lit(total).cast("bigint"))
    out = out.withColumns({"n_records": F.coalesce("n_records", F.lit(0)).cast("bigint"), "size": F.coalesce("size", F.lit(0)).cast("bigint")})
    out = out.withColumn("target", F.col("target_share") * F.col("total")).withColumn("capacity", F.col("size") * F.col("max_repeats"))
    rate = F.least(F.col("target") / F.col("size"), F.col("max_repeats").cast("double"))
    return out.withColumn("rate", F.when(F.col("size") > 0, F.greatest(rate, F.lit(0.0))).otherwise(F.lit(0.0)))


def _flier(seed: int, level: int, last: bool):
    """Flight of one block of a source, with landing on the last level."""

    def fly(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "at"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(key[1]), len(pdf), sum(str(key[0]).encode())])
        pdf = pdf.iloc[rng.permutation(len(pdf))].reset_index(drop=True)
        p = flight(pdf["p"].tolist(), pdf["size"].astype(float).tolist(), rng)
        return pdf[["source", "id", "at", "size", "base", "p"]].assign(p=land(p, rng) if last else p)

    return fly


def mix(records: DataFrame, ident: str, source: str, size: str, targets: DataFrame, target_source: str = "source", share: str = "target_share", repeats: str = "max_repeats", block: int = BLOCK, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). drawn: (ident, source, size, copies), the records taken at least once; report: one
    row per target source with what it should give and what it gives.

    Records of null or other sources are never drawn but count in the total that shares refer to. A
    record of null size has size 0. A null identifier is allowed; repeated rows are drawn separately.
    A source is `short` if the draw takes all of it as often as allowed and still gives less than its target.
    Empty tables give an empty draw. The same input gives the same draw.
    """
    at = F.when(F.col(ident).isNull(), F.monotonically_increasing_id())  # written, so it stays; tells records without identifier apart
    rows = write_table(records.select(at.alias("at"), F.col(ident).alias("id"), F.col(source).alias("given"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size")), "mix-rows").df
    wanted = write_table(plan(rows, "given", "size", targets, target_source, share, repeats), "mix-plan").df
    keyed = rows.withColumn("key", source_key(F.col("given")))
    every = keyed.join(F.broadcast(wanted.select("key", "source", "rate")), "key").withColumn("base", F.floor("rate").cast("int"))
    todo = every.select("source", "id", "at", "size", "base", (F.col("rate") - F.col("base")).alias("p"))
    decided = todo.filter("p = 0").select("source", "id", "size", F.col("base").alias("copies"))
    todo = todo.filter("p > 0")
    counts = {r["source"]: r["n_records"] for r in wanted.filter(F.col("rate") > F.floor("rate")).select("source", "n_records").collect()}
    level, parts = 0, [decided]
    schema = "source string, id {}, at bigint, size bigint, base int, p double".format(dict(rows.dtypes)["id"])
    while counts:
        blocks = {s: max(1, -(-n // block)) for s, n in counts.items()}
        last = all(b == 1 for b in blocks.values())
        table = todo.sparkSession.createDataFrame(list(blocks.items()), "source string, blocks int")

        # a fixed number of partitions: small blocks would be put together into one task otherwise
        tasks = min(sum(blocks.values()), int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        placed = todo.join(F.broadcast(table), "source").withColumn("_b", F.pmod(F.xxhash64("id", "at", "size", F.lit(level)), F.col("blocks"))).repartition(tasks, "source", "_b")
        flown = write_table(placed.groupBy("source", "_b").applyInPandas(_flier(seed, level, last), schema), "mix-flight").df
        parts.append(flown.filter("p IN (0, 1)").select("source", "id", "size", (F.col("base") + F.col("p")).cast("int").alias("copies")))
        todo = flown.filter("p > 0 AND p < 1")
        counts = {} if last else {r[0]: r[1] for r in todo.groupBy("source").count().collect()}
        level += 1
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    drawn = all_parts.filter("copies > 0")
    got = drawn.groupBy("source").agg(F.sum("copies").alias("drawn_records"), F.sum(F.col("copies") * F.col("size")).alias("drawn_size"), F.max("copies").alias("most_copies"))
    report = wanted.join(F.broadcast(got), "source", "left").na.fill(0, ["drawn_records", "drawn_size", "most_copies"])
    exhausted = F.col("drawn_records") == F.col("n_records") * F.col("max_repeats")
    report = report.withColumn("short", exhausted & (F.col("drawn_size") < F.col("target")))
    reached = F.sum("drawn_size").over(Window.partitionBy(F.lit(1)))  # over the report only: as many rows as targets
    report = report.withColumn("reached_share", F.when(reached > 0, F.col("drawn_size") / reached).otherwise(F.lit(0.0)))
    named = drawn.select(F.col("id").alias(ident), "source", F.col("size").alias("size"), "copies")
    return named, report.select("source", "target_share", "max_repeats", "n_records", "size", "target", "capacity", "rate", "drawn_records", "drawn_size", "most_copies", "reached_share", "short")
