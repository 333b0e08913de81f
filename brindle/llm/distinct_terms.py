"""How distinctive a term is per record: hypergeometric enrichment.

The collection is a bag of N term occurrences, K of them the term; a record is a draw of n of them, k
the term. The score is -ln of the exact upper tail P(X >= k), adjusted for false discoveries over all
(record, term) tests. The tail depends on (k, n, K) only; those combinations are few (there are at
most sqrt(2 N) different K), so tails and the adjustment are computed on the combinations and joined
back, and no test is ever ranked by itself. The adjustment cumulates over range partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.running import running
from brindle.operators.skew import hot_keys, salted_join
from brindle.sources.materialize import write_table

#: Combinations in one range partition of the adjustment.
PART = 50_000
#: Up to so many combinations (some 20 MB) are sent to every task; more are joined by key.
FEW_COMBOS = 500_000


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive arguments: the Stirling series, after shifting small arguments up."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        small = y < 10
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    r = 1.0 / y
    r2 = r * r
    series = r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 * (1 / 1680 - r2 / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _ln_choose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)


def upper_tail(k: np.ndarray, n: np.ndarray, big_k: np.ndarray, big_n: float) -> np.ndarray:
    """ln P(X >= k) for X hypergeometric: n draws from N of which K count. Exact sums of log-gamma terms."""
    k, n, big_k = (np.asarray(x, dtype=float) for x in (k, n, big_k))
    top = np.minimum(n, big_k)
    low = np.maximum(k, n - (big_n - big_k))  # fewer are impossible
    base = _ln_choose(np.full_like(n, big_n), n)
    total = np.full_like(n, -np.inf)
    j, live = low.copy(), low <= top
    mode = (n + 1) * (big_k + 1) / (big_n + 2)
    while live.any():
        at = np.where(live, j, 0.0)
        term = np.where(live, _ln_choose(big_k, np.minimum(at, big_k)) + _ln_choose(np.maximum(big_n - big_k, n - at), n - at) - base, -np.inf)
        total = np.logaddexp(total, term)
        j = j + 1
        # beyond the mode terms only fall; 45 below the sum in logarithms they add nothing
        live = live & (j <= top) & ~((j > mode + 1) & (term < total - 45))
    return np.minimum(np.where(k <= np.maximum(0, n - (big_n - big_k)), 0.0, total), 0.0)


def adjusted(combos: DataFrame, tests: int, parts: int) -> DataFrame:
    """`combos` (k, n, total, m, ln_p), m tests each, with the Benjamini-Hochberg adjusted probability q of each.

    A combination of no test gets the q that a test of its probability would have. Both cumulations run over
    range partitions; of equal probabilities the last in the order has the right rank and the others its q.
    """
    order = ["ln_p", "k", "n", "total"]
    up = running(combos, [F.asc(c) for c in order], sums={"upto": F.col("m")}, parts=parts)
    raw = F.when(F.col("upto") > 0, F.col("ln_p") + math.log(max(tests, 1)) - F.log("upto"))
    down = running(up.withColumn("raw", raw), [F.desc(c) for c in order], mins={"low": F.col("raw")}, parts=parts)
    return down.select(*order, F.least(F.lit(1.0), F.exp("low")).alias("q"))


def term_scores(records: DataFrame, record: str, terms: str, max_df: int | None = None) -> DataFrame:
    """(record, term, k, n, df, total, ln_p, score, q[, q_limit]): one row for each term of each record.

    `terms` is an array of terms with repetitions; a record given in several rows has them all. k is the
    term's count in the record, n the record's length, df the number of records with the term, total its
    count in the collection, score = -ln_p, q the Benjamini-Hochberg adjusted probability. Null records,
    null arrays, null terms and empty terms count for nothing; an empty table gives an empty one; other
    columns are ignored.

    With `max_df` q_limit is the largest q that a term of at most so many records can have there: its total
    is at most max_df times the most a record has of a term, the tail grows with the total, and q with the tail.
    """
    # explode_outer: for explode the optimizer would infer a filter on the terms and compute them twice, below the caller's distinct
    words = records.filter(F.col(record).isNotNull()).select(F.col(record).alias("r"), F.explode_outer(F.col(terms)).alias("t")).filter("t IS NOT NULL AND t <> ''")
    counts = write_table(words.groupBy("r", "t").agg(F.count(F.lit(1)).alias("k")), "term-counts").df
    lengths = counts.groupBy("r").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("c"))
    per_term = counts.groupBy("t").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("df"))
    size = counts.agg(F.sum("k"), F.count(F.lit(1)), F.max("k")).first()
    big_n, tests, most = float(size[0] or 0), int(size[1]), int(size[2] or 0)
    rows = salted_join(counts, per_term, "t", hot_keys(per_term, "t", n="df", total=tests), F.col("r"))
    rows = salted_join(rows, lengths.select("r", "n"), "r", hot_keys(lengths, "r", n="c", total=tests), F.col("t"))
    rows = write_table(rows, "term-tests").df

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ln_p=upper_tail(b.k.to_numpy(), b.n.to_numpy(), b.total.to_numpy(), big_n))

    combos = rows.groupBy("k", "n", "total").agg(F.count(F.lit(1)).alias("m"))
    if max_df is not None:
        bound = min(max_df * most, int(big_n))
        combos = combos.unionByName(combos.select("k", "n", F.lit(bound).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("m")).distinct()).groupBy("k", "n", "total").agg(F.sum("m").alias("m"))
    combos = write_table(combos.mapInPandas(tails, "k bigint, n bigint, total bigint, m bigint, ln_p double"), "term-combos").df
    n_combos = combos.count()
    scored = adjusted(combos, tests, max(1, -(-n_combos // PART)))
    if max_df is not None:
        limits = scored.filter(F.col("total") == bound).select("k", "n", F.col("q").alias("q_limit"))
        scored = scored.join(limits, ["k", "n"])
    if n_combos <= FEW_COMBOS:
        joined = rows.join(F.broadcast(scored), ["k", "n", "total"])
    else:  # many: the commonest combinations are hot keys
        key = F.concat_ws(" ", "k", "n", "total").alias("c")
        sizes = combos.select(key, F.col("m").alias("n"))
        joined = salted_join(rows.withColumn("c", key), scored.select(key, *[x for x in scored.columns if x not in ("k", "n", "total")]), "c", hot_keys(sizes, "c", total=tests), F.col("r"))
    extra = [] if max_df is None else ["q_limit"]
    return joined.select(F.col("r").alias(record), F.col("t").alias("term"), "k", "n", "df", "total", "ln_p", (-F.col("ln_p")).alias("score"), "q", *extra)


def telling_pairs(scores: DataFrame, record: str, max_df: int, pairs: DataFrame, left: str, right: str, left_text: Column, right_text: Column, words: Callable[[Column], Column]) -> DataFrame:
    """(left, right, term, score_left, score_right, df): pairs of records that share a term of at most `max_df` records.

    `scores` are of term_scores with the same `max_df`: terms are chosen by their adjusted score, which no term of so
    few records can miss, and the number of their records is checked. Pairs come from the term's own short
    record list (at most max_df^2 a term), never from a term that many records have; they must then occur
    in a row of `pairs` in which both texts hold the term among their `words`. Rows with a null in either
    text or identifier give no pair.
    """
    rare = scores.filter((F.col("q") <= F.col("q_limit")) & (F.col("df") <= max_df))
    a = rare.select(F.col(record).alias("a"), "term", F.col("score").alias("score_left"), "df")
    b = rare.select(F.col(record).alias("b"), "term", F.col("score").alias("score_right"))
    both = a.join(b, "term").filter("a <> b")
    given = pairs.select(F.col(left).alias("a"), F.col(right).alias("b"), left_text.alias("ta"), right_text.alias("tb"))
    hit = both.join(given, ["a", "b"])
    hit = hit.filter(F.array_contains(words(F.col("ta")), F.col("term")) & F.array_contains(words(F.col("tb")), F.col("term")))
    out = hit.groupBy("a", "b", "term").agg(*[F.max(c).alias(c) for c in ("score_left", "score_right", "df")])
    return out.withColumnsRenamed({"a": left, "b": right})
