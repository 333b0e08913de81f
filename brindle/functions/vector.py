"""Vector functions over array columns, in the JVM, and the eight-distance bundle in numpy batches.

Sums run in double precision over whatever the arrays hold. A zero denominator gives 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minkowski(a: Column, b: Column, p: float = 3.0) -> Column:
    """(sum |a-b|^p)^(1/p)."""
    return F.pow(total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def canberra(a: Column, b: Column) -> Column:
    """sum |a-b| / (|a|+|b|) over the coordinates where the denominator isn't 0."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > TINY, dot(a, b) / d).otherwise(F.lit(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the coordinates."""
    n = F.size(a)
    ma, mb = total(doubles(a)) / n, total(doubles(b)) / n
    cov = dot(a, b) / n - ma * mb
    va, vb = dot(a, a) / n - ma * ma, dot(b, b) / n - mb * mb
    d = F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0)))
    return F.when(d > TINY, cov / d).otherwise(F.lit(0.0))


def ordinal_ranks(v: Column) -> Column:
    """0-based ranks, ties by position."""
    at = F.array_sort(F.transform(doubles(v), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    back = F.array_sort(F.transform(at, lambda s, r: F.struct(s["i"].alias("i"), r.alias("r"))))
    return F.transform(back, lambda s: s["r"].cast("double"))


def spearman(a: Column, b: Column) -> Column:
    """Correlation of ordinal ranks; 0 where a vector is constant."""
    flat = (F.array_max(a) == F.array_min(a)) | (F.array_max(b) == F.array_min(b))
    return F.when(flat, F.lit(0.0)).otherwise(pearson(ordinal_ranks(a), ordinal_ranks(b)))


def l2_normalize(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(TINY))
    return F.transform(doubles(v), lambda x: x / n)


def mean_pool(cloud: Column, dim: int) -> Column:
    """Mean of an array of vectors, coordinate by coordinate."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: total(F.transform(cloud, lambda v: F.get(v, k).cast("double"))) / F.size(cloud))


def max_pool(cloud: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.array_max(F.transform(cloud, lambda v: F.get(v, k).cast("double"))))


# Names and order of the distance columns.
CLASSICAL = ["cls_euclidean", "cls_cosine_dist", "cls_cosine_sim", "cls_pearson", "cls_spearman", "cls_minkowski", "cls_canberra", "cls_chebyshev"]


def classical_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The eight distances of aligned rows."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    gap = np.abs(a - b)
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    cos = np.where(size > TINY, (a * b).sum(axis=1) / np.maximum(size, TINY), 0.0)

    def corr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        d = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        return np.where(d > TINY, (x * y).sum(axis=1) / np.maximum(d, TINY), 0.0)

    ranks = lambda x: x.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable").astype(float)
    flat = (np.ptp(a, axis=1) == 0) | (np.ptp(b, axis=1) == 0)
    both = np.abs(a) + np.abs(b)
    canb = np.divide(gap, both, out=np.zeros_like(gap), where=both > 0).sum(axis=1)
    return np.column_stack([np.sqrt((gap**2).sum(axis=1)), 1 - cos, cos, corr(a, b), np.where(flat, 0.0, corr(ranks(a), ranks(b))), np.cbrt((gap**3).sum(axis=1)), canb, gap.max(axis=1)])


def _classical_batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    ok = a.notna() & b.notna()
    out = np.zeros((len(a), len(CLASSICAL)))
    if ok.any():
        out[ok.to_numpy()] = classical_rows(np.stack(a[ok].to_list()), np.stack(b[ok].to_list()))
    return pd.DataFrame(out, columns=CLASSICAL)


#: The eight distances of two vector columns as a struct; zeros where a vector is missing.
classical_col = F.pandas_udf(_classical_batch, StructType([StructField(c, DoubleType()) for c in CLASSICAL]))
