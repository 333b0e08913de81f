"""Consolidating pairwise matches into groups.

Connected components by alternating large-star and small-star edge rewrites. An edge is kept as
(u, v) with u > v. The large star of a node links every larger neighbour to the smallest node it
knows; the small star links every smaller neighbour, and the node itself, to the smallest of them.
Both leave components as they are; when neither changes an edge, each component is a star around its
smallest identifier. Every rewrite is one pre-aggregated minimum and one join on the node, in which
hub nodes are salted, and every round is a written table. A rewrite never adds edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.skew import hot_keys, hot_limit, salted_join
from brindle.sources.materialize import Written, write_table


def _unsettled(edges: DataFrame) -> tuple[int, int, int]:
    """(edges, nodes that keep the edges from being stars, most edges of a node): a node with two edges downwards, or
    with edges both ways, is unsettled.

    Stars are exactly what neither rewrite changes.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    per = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"), F.count(F.lit(1)).alias("n"))
    n, bad, most = per.agg(F.sum("down"), F.count(F.when(F.col("down") + F.col("up") > 1, 1)), F.max("n")).first()
    return n or 0, bad, most or 0


def _hubs(counts: DataFrame, total: int, most: int) -> DataFrame:
    """Hot nodes; no job where no node has enough edges. A rewrite doesn't give a node more edges downwards than it had."""
    return hot_keys(counts, "u", total=total if most > hot_limit(total) else 0)


def _large_star(edges: DataFrame, total: int, most: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    larger = both.filter(F.col("v") > F.col("u"))
    joined = salted_join(larger, least.select("u", "m"), "u", _hubs(least, 2 * total, most), F.col("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int, most: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = salted_join(edges, least.select("u", "m"), "u", _hubs(least, total, most), F.col("v"))
    moved = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, left: str, right: str, max_rounds: int = 200) -> DataFrame:
    """(node, group): every node of `pairs` with the smallest identifier of its component.

    Rows with a null side are no links and name no nodes; a row with equal sides names a node of its
    own component; repeated and reversed rows count once; other columns are ignored. An empty input
    gives an empty table. Comparison is by byte. Ends when a whole round leaves the edges unchanged.
    """
    given = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    links = write_table(given.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    loops = links.df.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("group"))
    cur = Written(links.spark, links.url, links.df.filter("u <> v"))
    total, bad, most = _unsettled(cur.df)
    for _ in range(max_rounds):
        if not bad:
            break
        large = write_table(_large_star(cur.df, total, most), "cc-large")
        small = write_table(_small_star(large.df, total, most), "cc-small")
        if cur.url != links.url:
            cur.drop()
        large.drop()
        cur = small
        total, bad, most = _unsettled(cur.df)
    else:
        raise RuntimeError("components did not settle")
    star = cur.df
    named = star.select(F.col("u").alias("node"), F.col("v").alias("group"))
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("group"))
    return named.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("group").alias("group"))
