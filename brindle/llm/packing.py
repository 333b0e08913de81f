"""Filling fixed-capacity containers: a grouping genetic algorithm on islands.

A genome is a set of bins. Crossover copies well-filled bins of one parent into the other, dissolves the
bins of the other that hold items twice, and puts displaced items back best fit, largest first; mutation
dissolves the emptiest bins. Fitness is the mean of squared fill.

Items are dealt into blocks of bounded size; each block is evolved by several islands (one task each),
which hand their elite to the next island between epochs. Badly filled bins of all blocks are dissolved
into fewer blocks and packed again, until one block is left or that saves no bin. A block at its lower bound
(total size over capacity, rounded up) has nothing to gain and isn't evolved further. An item larger than
a container gives full containers of its own and a remainder; no other item is ever cut.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.materialize import write_table

BLOCK = 2000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 30
CHILDREN = 4
POPULATION = 12
ELITE = 3
#: A bin filled at least this much is final at once.
GOOD_FILL = 0.98


class _Open:
    """Bins by free room, for best fit."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))

    def put(self, item: int) -> None:
        size = self.sizes[item]
        at = bisect_left(self.room, (size, -1))
        if at == len(self.room):
            self.bins.append([item])
            insort(self.room, (self.capacity - size, len(self.bins) - 1))
        else:
            room, k = self.room.pop(at)
            self.bins[k].append(item)
            insort(self.room, (room - size, k))


def _best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """`items` put into `bins`, in the order given."""
    o = _Open(bins, sizes, capacity)
    for i in items:
        o.put(i)
    return o.bins


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    fill = [sum(sizes[i] for i in b) / capacity for b in bins]
    return sum(f * f for f in fill) / len(fill) if fill else 0.0


def _cross(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """A child of a with some of the better-filled half of b's bins injected."""
    fill = np.array([sum(sizes[i] for i in x) for x in b])
    good = np.argsort(-fill, kind="stable")[: max(1, len(b) // 2)]
    take = [b[k] for k in good if rng.random() < 0.5] or [b[good[0]]]
    seen = {i for x in take for i in x}
    kept, loose = [list(x) for x in take], []
    for x in a:
        if seen.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in seen]
    loose.sort(key=lambda i: -sizes[i])
    return _best_fit(kept, loose, sizes, capacity)


def _mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The emptiest bins and a few others dissolved and put back."""
    if len(bins) < 2:
        return bins
    fill = np.array([sum(sizes[i] for i in x) for x in bins])
    out = set(np.argsort(fill, kind="stable")[: max(1, len(bins) // 20)].tolist()) | set(rng.integers(0, len(bins), 2).tolist())
    loose = sorted((i for k in out for i in bins[k]), key=lambda i: -sizes[i])
    return _best_fit([list(x) for k, x in enumerate(bins) if k not in out], loose, sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, start: list[list[list[int]]] | None = None, generations: int = GENERATIONS) -> list[list[list[int]]]:
    """The ELITE best genomes after some generations, best first. Deterministic for a seed."""
    rng = np.random.default_rng(seed)
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    pop = [[list(x) for x in g] for g in start or []]
    if not pop:
        pop.append(_best_fit([], down, sizes, capacity))
    while len(pop) < POPULATION:
        noise = np.array(sizes) * rng.uniform(0.7, 1.3, len(sizes))
        pop.append(_best_fit([], np.argsort(-noise, kind="stable").tolist(), sizes, capacity))
    score = [_fitness(g, sizes, capacity) for g in pop]
    enough = -(-sum(sizes) // capacity)
    for _ in range(generations):
        if len(pop[int(np.argmax(score))]) <= enough:
            break
        for _ in range(CHILDREN):
            i, j = (int(max(rng.integers(0, len(pop), 2), key=lambda k: score[k])) for _ in range(2))
            child = _mutate(_cross(pop[i], pop[j], sizes, capacity, rng), sizes, capacity, rng)
            worst = int(np.argmin(score))
            if (f := _fitness(child, sizes, capacity)) > score[worst]:
                pop[worst], score[worst] = child, f
    best = sorted(range(len(pop)), key=lambda k: (-score[k], len(pop[k])))[:ELITE]
    return [pop[k] for k in best]


_GENOME = "block bigint, island int, fit double, ids array<string>, sizes array<int>, bins array<int>"


def _rows(block: int, island: int, ids: list[str], sizes: list[int], capacity: int, genomes: list) -> list[tuple]:
    out = []
    for g in genomes:
        where = np.empty(len(ids), dtype=np.int32)
        for k, b in enumerate(g):
            where[b] = k
        out.append((block, island, _fitness(g, sizes, capacity), ids, sizes, where))
    return out


def _pack_blocks(items: DataFrame, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(block, id, size, bin) of items (block, id, size): the best genome of each block."""
    cols = [c.split()[0] for c in _GENOME.split(", ")]

    def first(key, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values("id", kind="stable")
        ids, sizes = pdf["id"].tolist(), [int(x) for x in pdf["size"]]
        genomes = evolve(sizes, capacity, hash((seed, block, island, 0)) & 0x7FFFFFFF)
        return pd.DataFrame(_rows(block, island, ids, sizes, capacity, genomes), columns=cols)

    def again(epoch: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            block, island = int(key[0]), int(key[1])
            pdf = pdf.sort_values("fit", ascending=False, kind="stable")
            ids, sizes = list(pdf["ids"].iloc[0]), [int(x) for x in pdf["sizes"].iloc[0]]
            start = []
            for where in pdf["bins"]:
                bins: list[list[int]] = [[] for _ in range(int(max(where)) + 1)]
                for i, k in enumerate(where):
                    bins[k].append(i)
                start.append(bins)
            genomes = evolve(sizes, capacity, hash((seed, block, island, epoch)) & 0x7FFFFFFF, start)
            return pd.DataFrame(_rows(block, island, ids, sizes, capacity, genomes), columns=cols)

        return run

    here = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    genomes = write_table(here.groupBy("block", "island").applyInPandas(first, _GENOME), "pack-epoch")
    for epoch in range(1, epochs):
        elite = genomes.df.groupBy("block", "island").agg(F.max_by(F.struct("fit", "ids", "sizes", "bins"), "fit").alias("e"))
        guests = elite.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "e.*")
        both = genomes.df.unionByName(guests.select(*cols)) if islands > 1 else genomes.df
        later = write_table(both.groupBy("block", "island").applyInPandas(again(epoch), _GENOME), "pack-epoch")
        genomes.drop()
        genomes = later
    best = genomes.df.groupBy("block").agg(F.max_by(F.struct("ids", "sizes", "bins"), F.struct("fit", F.col("island"))).alias("b"))
    return best.select("block", F.explode(F.arrays_zip("b.ids", "b.sizes", "b.bins")).alias("x")).select("block", F.col("x.ids").alias("id"), F.col("x.sizes").alias("size"), F.col("x.bins").alias("bin"))


def pack(items: DataFrame, ident: str, size: str, capacity: int, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """(ident, piece, pieces, start, size, container): one row per piece of an item.

    Items up to `capacity` are one piece. Larger ones are cut into full pieces and a remainder (`start` is
    the first unit of the piece). Items of size 0, null or less take no room: pieces 0, container null.
    Rows with a null identifier are left out; a repeated identifier is packed once for each row. Other
    columns are ignored; an empty table gives an empty one. The same input gives the same result.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    given = items.filter(F.col(ident).isNotNull()).select(F.col(ident).alias("item"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    counts = given.groupBy("item", "n").agg(F.count(F.lit(1)).alias("copies"))
    pieces_of = F.ceil(F.col("n") / F.lit(capacity)).cast("int")
    one = counts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn("pieces", pieces_of)
    cut = one.withColumn("piece", F.explode_outer(F.when(F.col("pieces") > 0, F.sequence(F.lit(1), F.col("pieces")))))
    cut = cut.withColumn("start", (F.col("piece") - 1) * F.lit(capacity).cast("bigint"))
    cut = cut.withColumn("size", F.when(F.col("piece").isNull(), F.lit(0)).otherwise(F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("start"))).cast("int"))
    cut = cut.withColumn("id", F.concat_ws("/", F.col("item").cast("string"), F.col("n"), F.col("copy"), F.coalesce("piece", F.lit(0))))
    pieces = write_table(cut.select("item", "id", F.coalesce("piece", F.lit(0)).alias("piece"), "pieces", "start", "size"), "pack-pieces").df
    loose = pieces.filter((F.col("size") > 0) & (F.col("size") < capacity)).select("id", "size")
    n = loose.count()
    done, level = None, 0
    before = None  # bins that the loose items fill now
    while n:
        blocks = -(-n // block)
        packed = _pack_blocks(loose.select("id", "size").withColumn("block", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(blocks))), capacity, islands, epochs, seed + level)
        named = packed.withColumn("container", F.concat_ws("-", F.lit(f"L{level}"), F.col("block"), F.col("bin")))
        fill = named.groupBy("block", "bin").agg((F.sum("size") >= GOOD_FILL * capacity).alias("good"))
        named = write_table(named.join(fill, ["block", "bin"]), "pack-level").df
        bins, poor, n_poor = named.agg(F.count_distinct("container"), F.count_distinct(F.when(~F.col("good"), F.col("container"))), F.count(F.when(~F.col("good"), 1))).first()
        if before is not None and bins >= before:  # packing again saves nothing
            final, n = loose, 0
        elif blocks == 1:
            final, n = named, 0
        else:
            final, loose, n, before = named.filter("good"), named.filter("NOT good"), n_poor, poor
        done = final.select("id", "container") if done is None else done.unionByName(final.select("id", "container"))
        level += 1
    whole = F.when(F.col("size") == capacity, F.concat(F.lit("F-"), F.col("id")))
    if done is None:
        out = pieces.withColumn("container", whole)
    else:
        out = pieces.join(done, "id", "left").withColumn("container", F.coalesce(whole, F.col("container")))
    return out.select(F.col("item").alias(ident), "piece", "pieces", "start", "size", "container")
