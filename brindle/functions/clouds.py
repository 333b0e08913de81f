"""Measures of point clouds: spectra, persistent homology, local overlap. numpy, one call per cloud or pair.

Clouds are bounded by the number of tokens of a label, so each fits in a row. Homology in dimension 1
is exact up to H1_POINTS points and in dimension 2, on request, up to H2_POINTS; larger clouds give
counts of 0 with `truncated` set, never silently.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

H1_POINTS, H2_POINTS = 48, 20
SPECTRA = ["alpha_req", "ne_sum", "rank_me", "stable_rank", "self_cluster"]
SPECTRAL = [f"spc_{side}_{s}" for side in ("src", "tgt", "combined") for s in SPECTRA]
_UNARY = ["h0_count", "h1_count", "h2_count", "h0_max_life", "h1_max_life", "h2_max_life", "h0_entropy", "h1_entropy", "h2_entropy"]
TDA = [*[f"tda_{u}_{side}" for side in ("src", "tgt", "combined") for u in _UNARY], "tda_h0_bottleneck", "tda_h0_wasserstein", "tda_h1_bottleneck", "tda_h1_wasserstein", "tda_overlap_sym", "tda_overlap_a2b", "tda_overlap_b2a"]


def spectra(x: np.ndarray) -> list[float]:
    """Decay exponent of the singular values, normalised eigenvalue sum, effective rank by entropy, stable
    rank and self-clustering of a cloud, in the order of SPECTRA; 0 where a measure isn't defined."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    n, d = x.shape
    if x.size == 0:
        return [0.0] * 5
    s = np.linalg.svd(x, compute_uv=False)
    kept = s[s > 1e-10]
    alpha = effective = spread = cluster = 0.0
    if n > 1 and d > 1:
        if len(kept) > 1:
            alpha = -float(np.polyfit(np.log(np.arange(1, len(kept) + 1)), np.log(kept), 1)[0])
        if len(kept):
            p = kept / kept.sum()
            effective = float(np.exp(-(p * np.log(p + 1e-12)).sum()))
        gram = np.sqrt((s**4).sum())  # Frobenius norm of x x'
        cluster = float((d * gram - n * (d + n - 1)) / ((d - 1) * (n - 1) * n))
    if n > 1:
        own = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / (n - 1)
        spread = float(own.sum() / max(own[0], 1e-10))
    stable = float((s**2).sum() / s[0] ** 2) if s[0] >= 1e-10 else 0.0
    return [alpha, spread, effective, stable, cluster]


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        unit = lambda v: np.divide(v, (n := np.linalg.norm(v, axis=1, keepdims=True)), out=np.zeros_like(v), where=n > 0)
        return np.clip(1 - unit(x) @ unit(y).T, 0, 2)
    return np.sqrt(np.maximum(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2), 0))


def _h0(d: np.ndarray) -> np.ndarray:
    """Deaths of components: the edges of a minimum spanning tree, and one that lives on."""
    n = len(d)
    near, out, left = d[0].copy(), [], set(range(1, n))
    while left:
        k = min(left, key=lambda i: near[i])
        out.append(near[k])
        left.remove(k)
        near = np.minimum(near, d[k])
    return np.array([[0.0, x] for x in sorted(out)] + [[0.0, np.inf]])


def _higher(d: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Vietoris-Rips intervals of positive length in dimensions 1..top, by reducing the boundary matrix over Z/2."""
    n = len(d)
    cells = [((i,), 0.0) for i in range(n)]
    for k in range(2, top + 3):
        cells += [(c, max(d[i, j] for i, j in combinations(c, 2))) for c in combinations(range(n), k)]
    cells.sort(key=lambda c: (c[1], len(c[0]), c[0]))
    at = {c: i for i, (c, _) in enumerate(cells)}
    low: dict[int, int] = {}
    columns: dict[int, set[int]] = {}
    births: dict[int, int] = {}
    out: dict[int, list] = {k: [] for k in range(1, top + 1)}
    for j, (c, value) in enumerate(cells):
        col = {at[c[:i] + c[i + 1 :]] for i in range(len(c))} if len(c) > 1 else set()
        while col and (m := max(col)) in low:
            col ^= columns[low[m]]
        if col:
            m = max(col)
            low[m], columns[j] = j, col
            births.pop(m, None)
            k = len(c) - 2
            if 1 <= k <= top and value > cells[m][1] + 1e-12:
                out[k].append([cells[m][1], value])
        elif 2 <= len(c) <= top + 1:
            births[j] = len(c) - 1
    for j, k in births.items():
        out[k].append([cells[j][1], np.inf])
    return {k: np.array(v).reshape(-1, 2) for k, v in out.items()}


def diagrams(x: np.ndarray, metric: str = "euclidean", top: int = 1) -> tuple[list[np.ndarray], bool]:
    """(diagrams of dimensions 0, 1, 2; whether a dimension asked for was left out for size)."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    none = np.zeros((0, 2))
    if x.size == 0:
        return [none, none, none], False
    d = distances(x, x, metric)
    can = 2 if top >= 2 and len(x) <= H2_POINTS else 1 if top >= 1 and len(x) <= H1_POINTS else 0
    more = _higher(d, can) if can else {}
    return [_h0(d), more.get(1, none), more.get(2, none)], can < top


def lifetimes(dgm: np.ndarray) -> np.ndarray:
    """Lengths of the intervals that end."""
    return (dgm[:, 1] - dgm[:, 0])[np.isfinite(dgm[:, 1])] if len(dgm) else np.zeros(0)


def persistence_entropy(dgm: np.ndarray) -> float:
    life = lifetimes(dgm)
    life = life[life > 0]
    if not len(life):
        return 0.0
    p = life / life.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def unary(dgms: list[np.ndarray]) -> list[float]:
    """Counts, longest finite lifetimes and entropies of the three dimensions."""
    return [float(len(g)) for g in dgms] + [float(lifetimes(g).max(initial=0.0)) for g in dgms] + [persistence_entropy(g) for g in dgms]


def total_persistence(dgm: np.ndarray) -> float:
    return float(lifetimes(dgm).sum())


def _assignment(cost: np.ndarray) -> list[int]:
    """Columns of a least-cost assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, match, back = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        slack, seen = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        while True:
            seen[j] = True
            row = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = ~seen[1:] & (row < slack[1:])
            slack[1:][better], back[1:][better] = row[better], j
            free = np.where(seen, np.inf, slack)
            nxt = int(np.argmin(free))
            step = free[nxt]
            u[match[seen]] += step
            v[seen] -= step
            slack[~seen] -= step
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j], j = match[back[j]], back[j]
    out = [0] * n
    for col in range(1, n + 1):
        out[match[col] - 1] = col - 1
    return out


def _cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-norm distances of finite points, with the diagonal as partner of every point."""
    n, m = len(a), len(b)
    c = np.zeros((n + m, n + m))
    c[:n, :m] = np.abs(a[:, None, :] - b[None, :, :]).max(axis=2)
    c[:n, m:] = ((a[:, 1] - a[:, 0]) / 2)[:, None]
    c[n:, :m] = ((b[:, 1] - b[:, 0]) / 2)[None, :]
    return c


def _finite(g: np.ndarray) -> np.ndarray:
    return g[np.isfinite(g[:, 1])] if len(g) else g


def wasserstein(a: np.ndarray, b: np.ndarray, order: int = 2) -> float:
    """Wasserstein distance of the finite points under the max norm; 0 where a side has none."""
    a, b = _finite(a), _finite(b)
    if not len(a) or not len(b):
        return 0.0
    c = _cost(a, b) ** order
    return float(sum(c[i, j] for i, j in enumerate(_assignment(c))) ** (1 / order))


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """The smallest bound under which all finite points find partners; 0 where a side has none."""
    a, b = _finite(a), _finite(b)
    if not len(a) or not len(b):
        return 0.0
    c = _cost(a, b)
    bounds = np.unique(c)
    low, high = 0, len(bounds) - 1
    while low < high:
        mid = (low + high) // 2
        if _can_match(c <= bounds[mid]):
            high = mid
        else:
            low = mid + 1
    return float(bounds[low])


def _can_match(allowed: np.ndarray) -> bool:
    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in np.flatnonzero(allowed[i]).tolist():
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(allowed)))


def local_overlap(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> tuple[float, float, float]:
    """(symmetric, a to b, b to a): share of points whose nearest point of the other cloud is no farther than
    their nearest own neighbour; zeros where a cloud has fewer than two points."""
    a, b = np.atleast_2d(np.asarray(a, dtype=float)), np.atleast_2d(np.asarray(b, dtype=float))
    if a.size == 0 or b.size == 0 or len(a) < 2 or len(b) < 2:
        return 0.0, 0.0, 0.0

    def radius(x: np.ndarray) -> np.ndarray:
        d = distances(x, x, metric)
        np.fill_diagonal(d, np.inf)
        return d.min(axis=1)

    across = distances(a, b, metric)
    ab, ba = float((across.min(axis=1) <= radius(a)).mean()), float((across.min(axis=0) <= radius(b)).mean())
    return (ab + ba) / 2, ab, ba


def _cloud(x) -> np.ndarray:
    return np.array([list(v) for v in x], dtype=float) if x is not None and len(x) else np.zeros((0, 0))


def _spectra_batch(c: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([spectra(_cloud(x)) for x in c], columns=SPECTRA)


def _spectral_pair_batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    known: dict = {}

    def once(x) -> list[float]:
        key = x.tobytes()
        if key not in known:
            known[key] = spectra(x)
        return known[key]

    rows = []
    for x, y in zip(map(_cloud, a), map(_cloud, b)):
        both = np.vstack([x, y]) if x.size and y.size else x if x.size else y
        rows.append([*once(x), *once(y), *spectra(both)])
    return pd.DataFrame(rows, columns=SPECTRAL)


def _tda_pair_batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    known: dict = {}

    def once(x: np.ndarray):
        key = x.tobytes()
        if key not in known:
            known[key] = diagrams(x)
        return known[key]

    rows = []
    for x, y in zip(map(_cloud, a), map(_cloud, b)):
        both = np.vstack([x, y]) if x.size and y.size else x if x.size else y
        (p, cut_p), (q, cut_q), (r, cut_r) = once(x), once(y), once(both)
        rows.append([*unary(p), *unary(q), *unary(r), bottleneck(p[0], q[0]), wasserstein(p[0], q[0]), bottleneck(p[1], q[1]), wasserstein(p[1], q[1]), *local_overlap(x, y), cut_p or cut_q or cut_r])
    return pd.DataFrame(rows, columns=[*TDA, "truncated"])


def _diagram_batch(c: pd.Series) -> pd.Series:
    return pd.Series([[{"dim": float(k), "birth": float(p), "death": float(q)} for k, g in enumerate(diagrams(_cloud(x))[0]) for p, q in g] for x in c])


def _overlap_batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([local_overlap(_cloud(x), _cloud(y)) for x, y in zip(a, b)], columns=["sym", "a2b", "b2a"])


def _doubles(names: list[str], *more: StructField) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names] + list(more))


spectra_col = F.pandas_udf(_spectra_batch, _doubles(SPECTRA))
spectral_pair_col = F.pandas_udf(_spectral_pair_batch, _doubles(SPECTRAL))
tda_pair_col = F.pandas_udf(_tda_pair_batch, _doubles(TDA, StructField("truncated", BooleanType())))
diagram_col = F.pandas_udf(_diagram_batch, ArrayType(_doubles(["dim", "birth", "death"])))
overlap_col = F.pandas_udf(_overlap_batch, _doubles(["sym", "a2b", "b2a"]))
