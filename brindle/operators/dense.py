"""Dense retrieval: exact nearest vectors of every query, in blocks of the corpus.

Queries and corpus are cut into blocks of bounded size; a block of queries meets a block of the corpus in
one task as two matrices, which keeps k rows a query. No pair is ever a row of a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.vector import l2_normalize

BLOCK = 20_000


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_list()).astype(np.float64)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(src_iri, tgt_iri, score, rank): the k best corpus vectors of each query, equal scores by identifier.

    queries, corpus: (iri, vec). cosine scores zero vectors 0; l2 scores 1 / (1 + distance). Null vectors
    take no part. Query blocks meet corpus blocks in a join on block numbers; each block pair is one
    group of bounded size, and its partial top k are merged by a window over few rows.
    """
    q = queries.filter("iri IS NOT NULL AND vec IS NOT NULL").select("iri", "vec")
    c = corpus.filter("iri IS NOT NULL AND vec IS NOT NULL").select("iri", "vec")
    nq, nc = max(1, -(-q.count() // block)), max(1, -(-c.count() // block))
    qb = q.withColumn("qb", F.pmod(F.xxhash64("iri"), F.lit(nq)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    cb = c.withColumn("cb", F.pmod(F.xxhash64("iri"), F.lit(nc)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"src_iri": [], "tgt_iri": [], "score": []})
        right = right.sort_values("iri", kind="stable")
        a, b = _matrix(left["vec"]), _matrix(right["vec"])
        names = right["iri"].to_numpy()
        if metric == "cosine":
            unit = lambda x: np.divide(x, (n := np.linalg.norm(x, axis=1, keepdims=True)), out=np.zeros_like(x), where=n > 1e-12)
            a, b = unit(a), unit(b)
        out = []
        for i in range(0, len(a), 256):
            part = a[i : i + 256]
            if metric == "cosine":
                s = part @ b.T
            else:
                s = 1 / (1 + np.sqrt(np.maximum((part**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * part @ b.T, 0)))
            s = np.round(s, 12)
            n = min(k, s.shape[1])
            cut = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            for row, iri in enumerate(left["iri"].iloc[i : i + 256]):
                at = np.flatnonzero(s[row] >= cut[row, 0])
                at = at[np.argsort(-s[row, at], kind="stable")][:n]
                out.append(pd.DataFrame({"src_iri": iri, "tgt_iri": names[at], "score": s[row, at]}))
        return pd.concat(out)

    pairs = qb.groupBy("qb", "cb").cogroup(cb.groupBy("qb", "cb")).applyInPandas(best, "src_iri string, tgt_iri string, score double")
    w = Window.partitionBy("src_iri").orderBy(F.desc("score"), F.asc("tgt_iri"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# Where a pair may come from, and the threshold of lexical likeness.
BRICKS = ("brick_embedding_src", "brick_embedding_tgt", "brick_overlap", "brick_tfidf")
LEX_HIGH = 0.90


def brick_features(pairs: DataFrame, src_vectors: DataFrame, tgt_vectors: DataFrame, same_name: Column, likeness: Sequence[str] = ()) -> DataFrame:
    """`pairs` with bio_l2_sim, 1 / (1 + distance) of both vectors (an absent vector is zero), its rank from each side (ties by
    identifier), brick_lex_exact_norm, brick_consensus (found by two of BRICKS or more) and brick_lex_high (the
    same name, or one of the `likeness` columns at LEX_HIGH or more). Absent BRICKS columns count as 0."""
    a, b = src_vectors.select(F.col("iri").alias("src_iri"), F.col("vec").alias("_a")), tgt_vectors.select(F.col("iri").alias("tgt_iri"), F.col("vec").alias("_b"))
    d = pairs.join(a, "src_iri", "left").join(b, "tgt_iri", "left")
    square = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.pow(F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y.cast("double"), F.lit(0.0)), 2)), F.lit(0.0), lambda s, x: s + x)
    one = lambda c: F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("bio_l2_sim", 1 / (1 + F.sqrt(F.coalesce(square, one("_a"), one("_b"), F.lit(0.0))))).drop("_a", "_b")
    d = d.withColumn("bio_l2_rank_src", F.row_number().over(Window.partitionBy("src_iri").orderBy(F.desc("bio_l2_sim"), "tgt_iri")))
    d = d.withColumn("bio_l2_rank_tgt", F.row_number().over(Window.partitionBy("tgt_iri").orderBy(F.desc("bio_l2_sim"), "src_iri")))
    found = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in BRICKS if c in pairs.columns), F.lit(0))
    exact = F.coalesce(same_name, F.lit(False))
    high = exact
    for c in likeness:
        high = high | F.coalesce(F.col(c) >= LEX_HIGH, F.lit(False))
    return d.withColumns({"brick_lex_exact_norm": exact.cast("int"), "brick_consensus": (found >= 2).cast("int"), "brick_lex_high": high.cast("int")})


def reverse_hits(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs found from both sides, scored by the lower score. backward: (src_iri: a target, tgt_iri: a source, ...)."""
    b = backward.select(F.col("tgt_iri").alias("src_iri"), F.col("src_iri").alias("tgt_iri"), F.col("score").alias("back"), F.col("rank").alias("rank_tgt_src"))
    j = forward.select("src_iri", "tgt_iri", "score", F.col("rank").alias("rank_src_tgt")).join(b, ["src_iri", "tgt_iri"])
    return j.select("src_iri", "tgt_iri", F.least("score", "back").alias("score"), "rank_src_tgt", "rank_tgt_src")


class HashingEncoder:
    """Deterministic text vectors without a model: signed hashing of character trigrams, L2-normalized."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, df: DataFrame, iri: str, text: str) -> DataFrame:
        """(iri, vec, cloud): the vector of the text and one vector per word."""
        dim = self.dim

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import xxhash

            def vec(word: str) -> np.ndarray:
                v, s = np.zeros(dim), f" {word} "
                for i in range(max(len(s) - 2, 1)):
                    h = xxhash.xxh64_intdigest(s[i : i + 3])
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                return v

            for b in batches:
                clouds = [[vec(w) for w in (t or "").lower().split()] for t in b["text"]]
                whole = [sum(c, np.zeros(dim)) for c in clouds]
                whole = [v / max(np.linalg.norm(v), 1e-12) for v in whole]
                yield pd.DataFrame({"iri": b["iri"], "vec": [v.tolist() for v in whole], "cloud": [[v.tolist() for v in c] for c in clouds]})

        return df.select(F.col(iri).cast("string").alias("iri"), F.col(text).alias("text")).mapInPandas(run, "iri string, vec array<double>, cloud array<array<double>>")


def encode_missing(encoder, ents: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """`cache` with vectors of the entities it lacks."""
    new = ents.join(cache.select("iri"), "iri", "left_anti")
    return cache.unionByName(encoder.encode(new, "iri", text).select(*cache.columns))


def vector_quality(vectors: DataFrame) -> DataFrame:
    """(n, n_iri, n_null, min_dim, max_dim, n_bad): whether a vector table can be used. One row."""
    bad = F.exists("vec", lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("iri").alias("n_iri"), F.count(F.when(F.col("vec").isNull(), 1)).alias("n_null"), F.min(F.size("vec")).alias("min_dim"), F.max(F.size("vec")).alias("max_dim"), F.count(F.when(bad, 1)).alias("n_bad"))


def normalized(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", l2_normalize(F.col("vec")))
