"""All similar pairs between set-valued records: T-occurrence list merging.

Equal sets are one class, so copies are never compared with each other. Two different sets with
Jaccard similarity >= t share at least T = ceil(t (|x| + |y|) / (1 + t)) elements. In one global order
of elements (rare ones first) such sets meet in an element of both short prefixes, which is the key the
inverted lists are partitioned by; where that element is frequent, the key is that element and the next
one they share. The sets of a key that still has more than PART are dealt into parts, and each two parts meet,
so no task holds more than two parts of a key. Inside a partition each set probes the inverted lists of the smaller sets before it:
the longest lists are only binary-searched, the others are merged with a heap that skips records which
can't reach the count any more, and sets with T or more occurrences come out. Nothing is capped.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.skew import hot_keys, salted_join
from brindle.sources.materialize import write_table

#: Elements with more than 1/FREQUENT of all occurrences are listed; there are at most FREQUENT of them.
FREQUENT = 20_000
#: Most sets of one key that meet in one task.
PART = 20_000
#: Weight of a binary search against a heap step when the longest lists are chosen.
MU = 0.4

_POSITIVE = 0x7FFFFFFFFFFFFFFF


def least_overlap(t: Fraction, a: int, b: int) -> int:
    """Fewest shared elements that sets of these sizes need."""
    return math.ceil(t * (a + b) / (1 + t))


def least_partner(t: Fraction, a: int) -> int:
    return math.ceil(t * a)


def merge_skip(lists: list[list[int]], start: int, t: int) -> Iterator[tuple[int, int]]:
    """(position, occurrences) for positions >= start on at least t of the ascending lists."""
    heap = [(x[i], k, i) for k, x in enumerate(lists) if (i := bisect_left(x, start)) < len(x)]
    heapq.heapify(heap)
    while len(heap) >= t:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= t:
            yield top, len(popped)
            for _, k, i in popped:
                if i + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][i + 1], k, i + 1))
            continue
        while heap and len(popped) < t - 1:  # these can't reach t without the next one on the heap
            popped.append(heapq.heappop(heap))
        if not heap:
            return
        goal = heap[0][0]
        for _, k, i in popped:
            j = bisect_left(lists[k], goal, i)
            if j < len(lists[k]):
                heapq.heappush(heap, (lists[k][j], k, j))


def divide_skip(lists: list[list[int]], start: int, t: int) -> Iterator[tuple[int, int]]:
    """As merge_skip, but the longest lists are only searched for what the others bring up."""
    if len(lists) < t:
        return
    lists = sorted(lists, key=len)
    n_long = min(t - 1, len(lists) - 1, int(t / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    for pos, c in merge_skip(short, start, t - n_long):
        for x in long:
            i = bisect_left(x, pos)
            c += i < len(x) and x[i] == pos
        if c >= t:
            yield pos, c


def similar_in_group(sets: list[np.ndarray], t: Fraction) -> Iterator[tuple[int, int, int]]:
    """(i, j, overlap): indexes of different sets with similarity >= t, each pair once."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = [len(sets[i]) for i in order]
    index: dict[int, list[int]] = {}
    for pos, i in enumerate(order):
        x = sets[i].tolist()
        least = least_partner(t, len(x))
        lists = [index[e] for e in x if e in index]
        need = least_overlap(t, len(x), least)
        if len(lists) >= need:
            for other, c in divide_skip(lists, bisect_left(sizes, least), need):
                if c >= least_overlap(t, len(x), sizes[other]):
                    yield order[other], i, c
        for e in x:
            index.setdefault(e, []).append(pos)


def _keys(x: list[int], t: Fraction, frequent: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Partition keys of a set given in the global order, each with a bound of the sets it can have (0: few)."""
    need = min(least_overlap(t, len(x), b) for b in range(least_partner(t, len(x)), len(x) + 1))
    paired = t > Fraction(1, 2)  # then different sets this similar share two elements at least
    need = max(need, 2) if paired else need
    one, two = len(x) - need + 1, len(x) - need + 2
    for i in range(max(one, 0)):
        if x[i] not in frequent or not paired:
            yield x[i], frequent.get(x[i], 0)
        else:
            for j in range(i + 1, min(two, len(x))):
                yield hash((x[i], x[j])) & _POSITIVE, min(frequent[x[i]], frequent.get(x[j], 0))  # frequent ones come last


def _hot(classes: DataFrame, t: Fraction, frequent: dict[int, int]) -> dict[int, int]:
    """The parts of each key with more than PART sets: at most as many keys as all sets' keys over PART.

    Only sets that hold elements of more than PART sets (two of them where keys are pairs) can have such a key.
    """
    big = [e for e, n in frequent.items() if n > PART]
    least = 2 if t > Fraction(1, 2) else 1
    if len(big) < least:
        return {}
    known, most = classes.sparkSession.sparkContext.broadcast(frequent), PART

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = known.value
        for b in batches:
            keys = [k for ids in b["ids"].to_pylist() for k, bound in dict(_keys(sorted(ids, key=lambda e: (often.get(e, 0), e)), t, often)).items() if bound > most]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    may = classes.filter(F.size(F.array_intersect("ids", F.array(*[F.lit(e) for e in big]))) >= least).select("ids")
    counts = may.mapInArrow(sign, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART)
    return {r[0]: -(-r[1] // PART) for r in counts.collect()}


def class_table(records: DataFrame, record: str, elements: str) -> DataFrame:
    """(record, class_id, ids): the class of each record's set, named by a 16-byte hash. Null elements are dropped, repeated ones
    count once, records that are null or have an empty set are left out; equal rows appear once."""
    have = F.array_sort(F.array_distinct(F.filter(F.col(elements), lambda x: x.isNotNull())))
    rows = records.filter(F.col(record).isNotNull()).select(F.col(record).alias("record"), have.alias("e")).filter(F.size("e") > 0)
    return rows.select("record", F.unhex(F.md5(F.to_json("e"))).alias("class_id"), F.transform("e", lambda x: F.xxhash64(x)).alias("ids")).distinct()


def similar_classes(members: DataFrame, threshold: str) -> DataFrame:
    """(class_a, class_b, overlap, similarity) with class_a < class_b: every pair of different classes of
    `class_table`'s output with Jaccard similarity >= threshold, once. `threshold` is a decimal above
    0, given as text so that it is exact. An empty table gives an empty one."""
    t = Fraction(threshold)
    if not 0 < t <= 1:
        raise ValueError("threshold must be in (0, 1]")
    classes = write_table(members.select("class_id", "ids").dropDuplicates(["class_id"]), "set-classes").df
    counts = classes.select(F.explode("ids").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    total = classes.agg(F.sum(F.size("ids"))).first()[0] or 0
    frequent = {r[0]: r[1] for r in counts.filter(F.col("n") > max(total / FREQUENT, 50)).collect()}
    known = members.sparkSession.sparkContext.broadcast((frequent, _hot(classes, t, frequent)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, hot = known.value
        for b in batches:
            keys, rows, flat = [], [], []
            offsets = b["ids"].offsets.to_numpy()
            values = b["ids"].values.to_numpy()
            for r in range(b.num_rows):
                x = sorted(values[offsets[r] : offsets[r + 1]].tolist(), key=lambda e: (often.get(e, 0), e))
                flat.append(x)
                for k in dict(_keys(x, t, often)):
                    if k not in hot:
                        keys.append(k)
                        rows.append(r)
                        continue
                    own = zlib.crc32(b["class_id"][r].as_py()) % hot[k]
                    for o in range(hot[k]):
                        keys.append(hash((k, min(own, o), max(own, o))) & _POSITIVE)
                        rows.append(r)
            ids = pa.array(flat, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b["class_id"].take(pa.array(rows, pa.int64())), ids.take(pa.array(rows, pa.int64()))], names=["key", "class_id", "ids"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("class_a", pa.binary()), ("class_b", pa.binary()), ("overlap", pa.int32()), ("size_a", pa.int32()), ("size_b", pa.int32())])
        open_key, names, sets = None, [], []
        out: list[list] = [[], [], [], [], []]

        def flush() -> None:
            if len(names) > 1:
                for i, j, c in similar_in_group(sets, t):
                    i, j = (i, j) if names[i] < names[j] else (j, i)
                    for to, v in zip(out, (names[i], names[j], c, len(sets[i]), len(sets[j]))):
                        to.append(v)

        for b in batches:
            keys = b["key"].to_numpy()
            offsets, values, cls = b["ids"].offsets.to_numpy(), b["ids"].values.to_numpy(), b["class_id"].to_pylist()
            for r, key in enumerate(keys.tolist()):
                if key != open_key:
                    flush()
                    open_key, names, sets = key, [], []
                names.append(cls[r])
                sets.append(values[offsets[r] : offsets[r + 1]])
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                out = [[], [], [], [], []]
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    signed = classes.mapInArrow(sign, "key bigint, class_id binary, ids array<bigint>")
    sorted_keys = signed.repartition("key").sortWithinPartitions("key")
    pairs = sorted_keys.mapInArrow(merge, "class_a binary, class_b binary, overlap int, size_a int, size_b int").distinct()
    return pairs.select("class_a", "class_b", "overlap", (F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))).alias("similarity"))


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record_a, record_b): pairs of different records, record_a < record_b, of the same class or of a pair of classes.

    As many rows as there are such pairs, which grows with the square of a class; link_counts says the same in one
    row per record. Large classes are salted.
    """
    m = members.select("record", "class_id").distinct()
    a, b = m.withColumnsRenamed({"record": "ra", "class_id": "class_a"}), m.withColumnsRenamed({"record": "rb", "class_id": "class_b"})
    hot = hot_keys(m.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")), "class_id", least=PART)
    at = lambda c: hot.withColumnRenamed("class_id", c)
    across = salted_join(a, pairs.select("class_a", "class_b"), "class_a", at("class_a"), F.col("ra"))
    across = salted_join(b, across.select("class_b", "ra"), "class_b", at("class_b"), F.col("rb")).select("ra", "rb")
    within = salted_join(a.withColumnRenamed("class_a", "c"), b.withColumnRenamed("class_b", "c"), "c", at("c"), F.col("ra")).filter("ra < rb").select("ra", "rb")
    both = across.unionByName(within).filter("ra <> rb")
    return both.select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b")).distinct()


def link_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record, class_id, n_copies, n_links): one row per record and class, with the number of records of
    the same class besides it and of records in similar classes."""
    m = members.select("record", "class_id").distinct()
    sizes = m.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select("class_a", "class_b").unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    links = both.join(sizes.withColumnsRenamed({"class_id": "class_b"}), "class_b").groupBy(F.col("class_a").alias("class_id")).agg(F.sum("size").alias("n_links"))
    out = m.join(sizes, "class_id").join(links, "class_id", "left")
    return out.select("record", F.lower(F.hex("class_id")).alias("class_id"), (F.col("size") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
