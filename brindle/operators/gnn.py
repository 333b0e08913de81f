"""Graph encoder: attention message passing over a class graph, gated fusion with text vectors, contrastive training.

A layer joins edges with the projected vectors of their ends; the softmax over a receiver's edges is a
pre-aggregated maximum and two sums, so hub nodes are combined before they are shuffled. Matrix products run in
numpy batches with broadcast weights, whose size depends on the dimension only. Training uses sampled pairs of
bounded number on the driver and fits the gate only; the other weights stay as given. Encoding covers every node.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from brindle.functions.vector import dot

#: Training pairs, the first by hash; a documented bound.
MOST_PAIRS = 20_000
#: Hash buckets in which targets are numbered.
BUCKETS = 4096


@dataclass
class GraphWeights:
    """Projections of one layer, the two-layer perceptron after it and the gate."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    gate: np.ndarray
    eps: float = 0.0

    @staticmethod
    def random(dim: int, hidden: int = 128, seed: int = 2026) -> GraphWeights:
        r = np.random.default_rng(seed)
        m = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        return GraphWeights(m(dim, hidden), m(dim, hidden), m(dim, dim), m(dim, dim), m(dim, dim), m(2 * dim, dim))


def _apply(df: DataFrame, f, *cols: str):
    def batch(*parts: pd.Series) -> pd.Series:
        return pd.Series(list(f(*[np.stack(p.to_list()).astype(float) for p in parts])))

    return F.pandas_udf(batch, ArrayType(DoubleType()))(*cols)


def message_layer(nodes: DataFrame, edges: DataFrame, w: GraphWeights) -> DataFrame:
    """(iri, vec): per receiver softmax(q.k / sqrt(h)) weighted sum of v over its links, plus (1 + eps) x, through the perceptron.

    nodes: (iri, vec); edges: (x, y), y receives from x. A node without links keeps (1 + eps) x as its sum.
    """
    wb = nodes.sparkSession.sparkContext.broadcast(w)
    p = nodes.withColumn("q", _apply(nodes, lambda x: x @ wb.value.q, "vec")).withColumn("k", _apply(nodes, lambda x: x @ wb.value.k, "vec")).withColumn("v", _apply(nodes, lambda x: x @ wb.value.v, "vec"))
    e = edges.join(p.select(F.col("iri").alias("x"), "k", "v"), "x").join(p.select(F.col("iri").alias("y"), "q"), "y")
    e = e.select("y", "v", (dot(F.col("q"), F.col("k")) / float(np.sqrt(w.q.shape[1]))).alias("a"))
    top = e.groupBy("y").agg(F.max("a").alias("top"))
    e = e.join(top, "y").withColumn("a", F.exp(F.col("a") - F.col("top")))
    z = e.groupBy("y").agg(F.sum("a").alias("z"))
    long = e.select("y", "a", F.posexplode("v").alias("i", "x")).groupBy("y", "i").agg(F.sum(F.col("a") * F.col("x")).alias("s"))
    got = long.join(z, "y").groupBy("y").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("z")).alias("s")))).alias("m")).select(F.col("y").alias("iri"), F.transform("m", lambda s: s["s"]).alias("m"))
    j = nodes.join(got, "iri", "left").withColumn("m", F.coalesce("m", F.transform("vec", lambda x: F.lit(0.0))))

    def mlp(m: np.ndarray, x: np.ndarray) -> np.ndarray:
        h = m + (1 + wb.value.eps) * x
        return np.maximum(h @ wb.value.w1, 0) @ wb.value.w2

    return j.select("iri", _apply(j, mlp, "m", "vec").alias("vec"))


def gated_fusion(structure: DataFrame, text: DataFrame, w: GraphWeights) -> DataFrame:
    """(iri, vec): g * structure + (1 - g) * text with g = sigmoid of a linear map of both, L2-normalized."""
    wb = structure.sparkSession.sparkContext.broadcast(w)

    def fuse(s: np.ndarray, t: np.ndarray) -> np.ndarray:
        g = 1 / (1 + np.exp(-np.clip(np.hstack([s, t]) @ wb.value.gate, -40, 40)))
        out = g * s + (1 - g) * t
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    j = structure.select("iri", F.col("vec").alias("s")).join(text.select("iri", F.col("vec").alias("t")), "iri")
    return j.select("iri", _apply(j, fuse, "s", "t").alias("vec"))


def training_pairs(gold: DataFrame, targets: DataFrame, negatives: int = 10, seed: int = 2026) -> DataFrame:
    """(src_iri, tgt_iri, label): known pairs and, for each, `negatives` other targets, drawn by hash; repeated draws and the source's own are dropped.

    Targets are numbered densely, by bucket of a hash and within it, so every draw hits and every target can be drawn.
    """
    t = targets.select(F.col("iri").alias("t")).filter("t IS NOT NULL").distinct().withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "t"), F.lit(BUCKETS)))
    sizes = {r["bucket"]: r["n"] for r in t.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, starts = 0, []
    for b in sorted(sizes):
        starts.append((b, n))
        n += sizes[b]
    first = targets.sparkSession.createDataFrame(starts, "bucket bigint, first bigint")
    one = t.join(F.broadcast(first), "bucket").select("t", (F.col("first") + F.row_number().over(Window.partitionBy("bucket").orderBy("t")) - 1).alias("slot"))
    pos = gold.select("src_iri", "tgt_iri").distinct()
    draws = pos.select("src_iri", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("k"), "tgt_iri").withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), "src_iri", "tgt_iri", "k"), F.lit(max(n, 1))))
    neg = draws.join(one, "slot").select("src_iri", F.col("t").alias("tgt_iri")).distinct().join(pos, ["src_iri", "tgt_iri"], "left_anti")
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


def fit_gate(structure: DataFrame, text: DataFrame, pairs: DataFrame, w: GraphWeights, epochs: int = 30, rate: float = 0.05, patience: int = 8, clip: float = 1.0) -> tuple[GraphWeights, list[float]]:
    """The gate trained by gradient descent on a logistic contrastive loss over at most MOST_PAIRS pairs, with clipped
    gradients and early stopping; (weights, loss by epoch)."""
    both = structure.select("iri", F.col("vec").alias("s")).join(text.select("iri", F.col("vec").alias("t")), "iri")
    a, b = both.select(F.col("iri").alias("src_iri"), F.col("s").alias("sa"), F.col("t").alias("ta")), both.select(F.col("iri").alias("tgt_iri"), F.col("s").alias("sb"), F.col("t").alias("tb"))
    rows = pairs.orderBy(F.xxhash64("src_iri", "tgt_iri")).limit(MOST_PAIRS).join(a, "src_iri").join(b, "tgt_iri").orderBy("src_iri", "tgt_iri").toPandas()
    if rows.empty:
        return w, []
    sa, ta, sb, tb = (np.stack(rows[c].to_list()).astype(float) for c in ("sa", "ta", "sb", "tb"))
    y = rows["label"].to_numpy(dtype=float)
    gate, best, kept, losses, waited = w.gate.copy(), np.inf, w.gate.copy(), [], 0

    def side(s, t, g):
        x = np.hstack([s, t])
        z = 1 / (1 + np.exp(-np.clip(x @ g, -40, 40)))
        return x, z, z * s + (1 - z) * t

    for _ in range(epochs):
        xa, za, ua = side(sa, ta, gate)
        xb, zb, ub = side(sb, tb, gate)
        p = 1 / (1 + np.exp(-np.clip((ua * ub).sum(1), -40, 40)))
        loss = float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean())
        losses.append(loss)
        if loss < best - 1e-6:
            best, kept, waited = loss, gate.copy(), 0
        elif (waited := waited + 1) >= patience:
            break
        d = ((p - y) / len(y))[:, None]
        grad = xa.T @ (d * ub * (sa - ta) * za * (1 - za)) + xb.T @ (d * ua * (sb - tb) * zb * (1 - zb))
        grad *= min(1.0, clip / max(np.linalg.norm(grad), 1e-12))
        gate = gate - rate * grad
    return GraphWeights(w.q, w.k, w.v, w.w1, w.w2, kept, w.eps), losses


def encode_graph(text: DataFrame, edges: DataFrame, w: GraphWeights, layers: int = 2) -> DataFrame:
    """(iri, vec): message passing, then fusion with the text vectors."""
    x = text
    for _ in range(layers):
        x = message_layer(x, edges, w)
    return gated_fusion(x, text, w)
