"""Splits that keep related records together: grouped iterative stratification.

Records that share a key are one component and go to one split. Components carry label vectors (the
counts of every label in their records). Placing repeats: take the label with the fewest records still
to place, the largest component with it, and the split that still needs that label most.

Components with more than a fixed share of all records, of which there can be only so many, are placed
first, on the driver. The others are dealt into blocks of bounded size by a hash of their key; each
block is stratified by itself towards its share of what the splits still need, so no task holds more
than one block and the error of a block stays below one of its components for each label.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import components
from brindle.sources.materialize import write_table

BLOCK = 20_000
#: Equal rows without a key are numbered in runs of this length.
RUN = 10_000
#: A component with more than 1/LARGE of all records is placed on the driver; there are at most LARGE.
LARGE = 1000
#: Targets come to the driver, and every block holds a row of needs for each of them.
MOST_SPLITS = 1000


def stratify(vectors: np.ndarray, desired: np.ndarray) -> np.ndarray:
    """The split of each component. vectors: components x labels; desired: splits x labels, changed in place.

    The last label column counts all records and breaks ties between splits.
    """
    n, width = vectors.shape
    where = np.full(n, -1)
    outstanding = vectors.sum(axis=0).astype(float)
    order = {}
    for lab in range(width):
        has = np.flatnonzero(vectors[:, lab])
        order[lab] = has[np.argsort(-vectors[has, lab], kind="stable")].tolist()[::-1]
    left = n
    while left:
        live = np.flatnonzero(outstanding > 0)
        if not len(live):  # components without any record
            where[where < 0] = int(np.argmax(desired[:, -1]))
            break
        lab = int(live[np.argmin(outstanding[live])])
        queue = order[lab]
        while queue and where[queue[-1]] >= 0:
            queue.pop()
        if not queue:
            outstanding[lab] = 0
            continue
        c = queue.pop()
        need = desired[:, lab]
        best = np.flatnonzero(need >= need.max() - 1e-9)
        s = int(best[np.argmax(desired[best, -1])])
        where[c] = s
        desired[s] -= vectors[c]
        outstanding -= vectors[c]
        left -= 1
    return where


def _link(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`records` with a column `component`: the one key, or the component of several keys."""
    if len(keys) == 1:
        return records.withColumn("component", F.col(keys[0]).cast("string"))
    tagged = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    first = F.coalesce(*tagged)
    links = None
    for t in tagged:
        one = records.select(first.alias("a"), t.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
        links = one if links is None else links.unionByName(one)
    groups = components(links, "a", "b").withColumnsRenamed({"node": "_first", "group": "component"})
    return records.withColumn("_first", first).join(groups, "_first", "left").drop("_first")


def _singled(comps: DataFrame, counts: Sequence[str]) -> DataFrame:
    """`comps` with those marked `alone`, which count equal rows, listed row by row; the occurrence, from 0, is added to their names."""
    n = F.when(F.col("alone"), F.col("n_rows")).otherwise(1)
    runs = comps.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / RUN)))).withColumn("_from", F.col("_run") * RUN)
    listed = runs.withColumn("_at", F.explode(F.sequence("_from", F.least(n, F.col("_from") + RUN) - 1)))
    single = {c: F.when(F.col("alone"), F.col(c) / F.col("n_rows")).otherwise(F.col(c)).cast("bigint") for c in counts}
    named = F.when(F.col("alone"), F.concat("component", F.lit("-"), F.col("_at").cast("string"))).otherwise(F.col("component"))
    return listed.withColumns(single | {"component": named}).drop("_run", "_from", "_at")


def grouped_splits(records: DataFrame, keys: Sequence[str], labels: dict[str, Column], targets: DataFrame, name: str = "split_name", share: str = "target_share", audit: str | None = None, block: int = BLOCK, alone: bool = False) -> DataFrame:
    """(component, split, n_rows, one count per label[, n_AUDIT][, alone]): every component with the split it is put in.

    `labels` are conditions over a record. Records of which all keys are null have no component and are
    left out, or with `alone` each is a component of its own, marked in that column and stratified with the rest;
    null label conditions count as false. Targets with null or no positive share get nothing;
    shares are scaled to sum 1; more than MOST_SPLITS of them are an error. n_AUDIT is the number of distinct
    non-null values of the column `audit` among the component's records in its split, counted after placing. Empty records
    give an empty table; without a usable target the split is null.
    """
    given = [(r[0], float(r[1])) for r in targets.groupBy(name).agg(F.max(share)).orderBy(name).limit(MOST_SPLITS + 1).collect() if r[1] is not None and r[1] > 0]
    if len(given) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    names, shares = [g[0] for g in given], np.array([g[1] for g in given])
    shares = shares / shares.sum() if len(shares) else shares
    labs = list(labels)
    rows = _link(records, keys)
    if alone:  # equal rows are counted under the hash of their columns first, so no task holds all of them
        rows = rows.withColumn("alone", F.col("component").isNull()).withColumn("component", F.coalesce("component", F.md5(F.to_json(F.struct(*records.columns)))))
    rows = rows.filter(F.col("component").isNotNull())
    aggs = [F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(k) for k, cond in labels.items()]
    given_by = ["component", *["alone"] * alone]
    parts = rows.groupBy(*given_by, *([audit] if audit else [])).agg(*aggs, F.count(F.lit(1)).alias("n_rows"))
    if audit:  # one row for each value of a component, of which both its totals and the audit are made
        parts = write_table(parts, "split-values").df
        comps = parts.groupBy(*given_by).agg(*[F.sum(c).alias(c) for c in (*labs, "n_rows")])
    else:
        comps = parts
    comps = write_table(_singled(comps, [*labs, "n_rows"]) if alone else comps, "split-components").df
    width = [*labs, "n_rows"]
    sums = comps.agg(*[F.sum(c) for c in width], F.count(F.lit(1))).first()
    if not names:
        return _audited(comps.withColumn("split", F.lit(None).cast("string")), parts, audit, alone)
    total = np.array([float(x or 0) for x in sums[:-1]])
    desired = shares[:, None] * total[None, :]
    is_large = F.col("n_rows") > max(total[-1] / LARGE, 1)
    large = comps.filter(is_large).orderBy(F.desc("n_rows"), "component").collect()
    placed = []
    if large:
        vec = np.array([[r[c] for c in width] for r in large], dtype=float)
        placed = [(r["component"], names[s]) for r, s in zip(large, stratify(vec, desired))]
    # what is still needed, as shares of what is left, label by label
    left = np.maximum(desired, 0)
    ratio = left / np.maximum(left.sum(axis=0, keepdims=True), 1e-12)
    blocks = max(1, -(-int(sums[-1]) // block))
    out_cols = [c for c in comps.columns]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component", kind="stable").reset_index(drop=True)
        vec = pdf[width].to_numpy(dtype=float)
        where = stratify(vec, ratio * vec.sum(axis=0, keepdims=True))
        return pdf[out_cols].assign(split=[names[s] for s in where])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in comps.schema.fields) + ", split string"
    small = comps.filter(~is_large).withColumn("_block", F.pmod(F.xxhash64("component"), F.lit(blocks)))
    small = small.groupBy("_block").applyInPandas(place, schema)
    heads = comps.sparkSession.createDataFrame(placed, "component string, split string")
    big = comps.filter(is_large).join(F.broadcast(heads), "component").select(*out_cols, "split")
    return _audited(write_table(small.unionByName(big), "split-placed").df if audit else small.unionByName(big), parts, audit, alone)


def _audited(placed: DataFrame, parts: DataFrame, audit: str | None, alone: bool) -> DataFrame:
    """`placed` with n_AUDIT: how many non-null values of `audit` each component's records hold that now share its split.

    A record that is a component of its own has one value or none.
    """
    if audit is None:
        return placed
    whole = placed.filter("NOT alone") if alone else placed
    now = parts.filter("NOT alone") if alone else parts
    per = now.select("component", audit).join(whole.select("component", "split"), "component").groupBy("component", "split").agg(F.count(audit).cast("int").alias(f"n_{audit}"))
    out = whole.join(per.withColumnRenamed("split", "_split"), "component", "left").filter(F.col("split").eqNullSafe(F.col("_split"))).drop("_split")
    if not alone:
        return out
    one = parts.filter("alone").select("component", F.col(audit).isNotNull().cast("int").alias(f"n_{audit}"))
    single = placed.filter("alone").withColumn("_c", F.substring_index("component", "-", 1))
    return out.unionByName(single.join(one.withColumnRenamed("component", "_c"), "_c").drop("_c").select(out.columns))
