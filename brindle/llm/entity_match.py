"""Matching entities across sources without keys.

1. Vocabulary without a dictionary. An entity's own names are paraphrases of each other, so two words, or
   a word and a two-word phrase, that replace each other in them again and again are one meaning, and
   words that come and go are optional. Words of definitions that foretell a meaning of the names stand
   for it. Only words that many entities use are learned about; their number is bounded.
2. Profiles. An entity becomes its meanings, each with the share of its names that has it, its rare words
   (invented names, aliases) likewise, and its names as sets of meanings. Short words and words with digits
   are rare words of entities that are named by them; of others they are only keys. Entities most of whose names have no
   rare word (common ones, such as classes with very many identifiers) are plain: their meanings name them.
3. Candidates. All entities that share a rare word, in either source and across, are compared, however many
   have it. Plain entities that share none are compared if they share more than half of their meanings; they
   meet under pairs of meanings. A word, or a pair of meanings, with many entities is dealt into parts, every
   two of which meet, so no task holds more than two parts at a time.
4. Scores. A two-component Gaussian mixture over the similarity vectors, with covariances regularised in
   proportion to the distance of the means, is fitted by expectation-maximisation without labels, over
   the counts of equal vectors. After every round transitivity is enforced: where b matches both its best
   partner p and c, the posterior of (b, c) may not exceed what the pair (p, c) allows.
"""

from __future__ import annotations

import gc
import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.normal import strip_accents_py
from brindle.sources.materialize import write_table

#: A word of more than max(50, entities / USUAL) entities is usual; every entity has a bounded number of
#: words, so the list of usual words is bounded too.
USUAL, USUAL_LEAST = 2000, 50
#: Shares of a word's entities in which a replacement, or an omission, must be seen to be learned.
REPLACES, OMITS = 0.2, 0.15
#: A definition word stands for a meaning that at least this share of its entities have, if it's this much over the base rate.
FORETELLS, LIFT, SUPPORT = 0.9, 3.0, 20
LONG = 10  # texts with at least so many words are definitions, shorter ones names
KEEP = 0.45  # share of its names in which an entity's meaning must be
DIMS = 3
CEILING = 500  # entities of a rare word of more are compared in parts of about so many
PART = 2000  # entities of one pair of meanings are compared in parts of about so many
GRID, CAPS = 32, 8  # similarity values and caps are counted on grids of these steps: at most (GRID + 1)^DIMS (CAPS + 1) cells
_CUT = "\x1e"  # between the texts of an entity; in a text it would separate words anyway
_CODE = re.compile(r"^\s*(?:[A-Za-z]{1,6}:\s?\w*\d\w*|\d{4}-\d\d-\d\d|https?://\S+|[A-Z]{2}_\d+)\s*$")
_CAMEL = re.compile(r"[A-Z](?<=[a-z0-9][A-Z])")


def _collected(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`f` without the search for reference cycles, which costs it a third of its time and never finds one."""

    def run(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from f(batches)
        finally:
            gc.enable()

    return run


class _Blanks(dict):
    def __missing__(self, key: int) -> str:
        return " "


#: For str.translate: everything but lower-case letters, digits and the cut becomes a blank.
_PLAIN = _Blanks({i: chr(i) for i in (*range(48, 58), *range(97, 123), 30)})


def parse(texts: str) -> tuple[list[str], list[int], set[str]]:
    """(words, names, definition words) of an entity's texts, in any order: `names` are sets of words, as bits, without repetition."""
    texts = _CUT.join(sorted(set(texts.split(_CUT))))
    low = texts if texts.isascii() else strip_accents_py(texts)
    low = _CAMEL.sub(r" \g<0>", low).lower().translate(_PLAIN)
    names, long = [], set()
    for t, w in zip(texts.split(_CUT), low.split(_CUT)):
        if (":" in t or "-" in t or "_" in t) and _CODE.match(t):
            continue
        w = w.split()
        if len(w) >= LONG:
            long.update(w)
        elif w:
            names.append(w)
    words = sorted({w for n in names for w in n})
    bit = {w: 1 << i for i, w in enumerate(words)}
    masks: dict[int, None] = {}
    for n in names:
        m = 0
        for w in n:
            m |= bit[w]
        masks[m] = None
    return words, list(masks), long


def entities(profiles: DataFrame, ident: str, side: Column, texts: Column) -> DataFrame:
    """(iri, side, words, names, defs): one row per identifier, the words of its names (joined by blanks), its names
    (distinct sets of those words, as bits) and its definition words. Plain strings, since lists of
    strings are slow to move to Python and back.

    `texts` is an array of strings. Null elements, codes, dates and identifiers are dropped; equal rows
    count once; of an identifier given with different content one row is taken, the first by hash. A null array is an
    empty one.
    """
    rows = profiles.filter(F.col(ident).isNotNull()).select(F.col(ident).alias("iri"), side.alias("side"), F.coalesce(F.array_join(texts, _CUT), F.lit("")).alias("texts"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [parse(t) for t in b["texts"]]
            yield pd.DataFrame({"iri": b["iri"], "side": b["side"], "words": [" ".join(w) for w, _, _ in out], "names": [pickle.dumps(n) for _, n, _ in out], "defs": [" ".join(sorted(d)) for _, _, d in out]})

    # parsed first: what is shuffled then is half as much, and rows that differ in the order of their texts are equal
    parsed = rows.mapInPandas(_collected(split), "iri string, side int, words string, names binary, defs string")
    content = ["side", "words", "names", "defs"]
    return parsed.groupBy("iri").agg(F.min_by(F.struct(*content), F.xxhash64(*content)).alias("r")).select("iri", "r.*")


class Vocabulary:
    """Learned meanings: usual words, what each stands for, phrases, optional words, what definition words foretell."""

    def __init__(self, usual: dict[str, int], replaced: Counter):
        self.usual = usual
        optional = {k[1][0] for k, n in replaced.items() if not k[0] and len(k[1]) == 1 and n >= OMITS * usual[k[1][0]]}
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        merged: Counter = Counter()
        for (a, b), n in replaced.items():
            a, b = tuple(w for w in a if w not in optional or len(a) == 1), tuple(w for w in b if w not in optional or len(b) == 1)
            if a and b:
                merged[(a, b) if a < b else (b, a)] = max(n, merged[(a, b) if a < b else (b, a)])
        phrases = []
        for (a, b), n in sorted(merged.items()):
            if len(a) == len(b) == 1 and a != b and n >= REPLACES * min(usual[a[0]], usual[b[0]]):
                x, y = find(a[0]), find(b[0])
                if x != y:
                    parent[max(x, y)] = min(x, y)
            elif {len(a), len(b)} == {1, 2}:
                one, two = (a, b) if len(a) == 1 else (b, a)
                if n >= REPLACES * usual[one[0]] and one[0] not in two:
                    phrases.append((two, one[0]))
        self.stands_for = {w: find(w) for w in usual}
        replaced_words = {w for w, r in self.stands_for.items() if r != w} | set(self.stands_for[w] for w, r in self.stands_for.items() if r != w)
        self.optional = optional - replaced_words
        self.known: dict[tuple[str, ...], tuple[frozenset[str], str]] = {}
        self.phrases = [(frozenset(self.stands_for[w] for w in two), self.stands_for[one]) for two, one in phrases]
        self.foretold: dict[str, tuple[str, ...]] = {}

    def meanings(self, words: tuple[str, ...]) -> tuple[frozenset[str], str]:
        """The meanings of usual words, given in one order, and their name."""
        got = self.known.get(words)
        if got is None:
            m = frozenset(self.stands_for[w] for w in words if w not in self.optional)
            for two, one in self.phrases:
                if two <= m:
                    m = (m - two) | {one}
            got = m, " ".join(sorted(m))
            if len(self.known) < 200_000:
                self.known[words] = got
        return got

    def profile(self, words: list[str], names: list[int]) -> tuple[dict[str, float], dict[str, float], dict[str, float], frozenset[str], bool]:
        """(meanings, rare words, names as sets of meanings, each with its share of the names; other words that are keys; plain) of one entity."""
        usual, few_of, alpha_bits, other_bits = self.usual, [], [], []
        is_usual = is_alpha = 0
        for i, w in enumerate(words):
            if w in usual:
                few_of.append((1 << i, w))
                is_usual |= 1 << i
            elif len(w) > 3 and w.isalpha():
                alpha_bits.append((1 << i, w))
                is_alpha |= 1 << i
            else:
                other_bits.append((1 << i, w))
        count = lambda bits: {w: sum([1 for m in names if m & b]) for b, w in bits}
        rare, odd, total, coded = count(alpha_bits), frozenset([w for _, w in other_bits]), 0, 0
        groups: dict[int, int] = {}  # names with the same usual words, alike in having rare ones (the two lowest bits)
        for m in names:
            k = (m & is_usual) << 2
            if m & is_alpha:
                k += 2
                total += 1
            if m & ~is_usual:
                k += 1
                coded += 1
            groups[k] = groups.get(k, 0) + 1
        parsed, known = [], self.known
        for k, n in groups.items():
            few = k >> 2
            some = tuple([w for b, w in few_of if few & b])
            m, key = known.get(some) or self.meanings(some)
            parsed.append((m, key, k & 2, k & 1, some, n))
        at = 2
        if total < KEEP * coded:  # named by short words or words with digits
            rare, odd, total, at = rare | count(other_bits), frozenset(), coded, 3
        if total < KEEP * len(names):
            told = [(m, key, n) if m else (x := frozenset(self.stands_for[w] for w in some), " ".join(sorted(x)), n) for m, key, _, _, some, n in parsed if some]
            core, whole = self._shares(told)
            if core:
                total = max(total, 1)
                return core, {w: c / total for w, c in rare.items()}, whole, odd, True
        told = [p for p in parsed if p[at] and len(p[0]) > 1] or [p for p in parsed if p[at]] or [p for p in parsed if len(p[0]) > 1]
        core, whole = self._shares([(p[0], p[1], p[5]) for p in told])
        total = max(total, 1)
        return core, {w: c / total for w, c in rare.items()}, whole, odd, False

    @staticmethod
    def _shares(told: list[tuple[frozenset[str], str, int]]) -> tuple[dict[str, float], dict[str, float]]:
        n = max(sum([c for _, _, c in told]), 1)
        whole: dict[str, float] = {}
        core: dict[str, float] = {}
        sets = {}
        for m, key, c in told:
            whole[key] = whole.get(key, 0) + c
            sets[key] = m
        for key, c in whole.items():
            for w in sets[key]:
                core[w] = core.get(w, 0) + c
        return {w: c / n for w, c in core.items() if c >= KEEP * n}, {w: c / n for w, c in whole.items()}

    def keys(self, core: dict[str, float]) -> list[str]:
        """Keys of which two sets of meanings share one if their common part is more than half of their union.

        Then more than half of either set is common, so the two rarest common meanings are among the rarest
        size - least + 2 of both; a set of one meaning can only meet its equal.
        """
        order = self.ordered(core)
        if len(order) < 2:
            return order
        return [" ".join(x) for x in combinations(order[: len(order) - (len(order) // 2 + 1) + 2], 2)]

    def ordered(self, meanings: Iterable[str]) -> list[str]:
        return sorted(meanings, key=lambda w: (self.usual.get(w, 0), w))

    def foretell(self, core: dict[str, float], defs: list[str]) -> dict[str, float]:
        """`core` with what the definition's words stand for."""
        for d in defs:
            for m in self.foretold.get(d, ()):
                core[m] = max(core.get(m, 0.0), 0.8)
        return core


def crossed(left: list[list[int]], right: list[list[int]]) -> tuple[list[int], list[int]]:
    """(pairs, counts): every pair of a number of a list of `left` and one of the same list of `right`, the first shifted by 32 bits."""
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a, b = np.fromiter((x for y in left for x in y), np.int64), np.fromiter((x for y in right for x in y), np.int64)
    times = np.repeat(m, n)  # how often each number of `left` comes
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(np.repeat(np.cumsum(m) - m, n), times)
    pairs, counts = np.unique((np.repeat(a, times) << 32) | b[at], return_counts=True)
    return pairs.tolist(), counts.tolist()


def learn(ents: DataFrame) -> tuple[Vocabulary, DataFrame, int]:
    """The vocabulary of all entities, their profiles (iri, side, rare, plain, packed) as a written table,
    and the most entities that a word that isn't usual has.

    What comes to the driver are lists bounded by USUAL and SUPPORT.
    """
    sc = ents.sparkSession.sparkContext
    n = ents.count()
    words = ents.select(F.explode(F.split("words", " ")).alias("w")).filter("w <> ''")
    limit = max(USUAL_LEAST, n / USUAL)
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found, most = counts.agg(F.collect_list(F.when(F.col("n") > limit, F.struct("w", "n"))), F.max(F.when(F.col("n") <= limit, F.col("n")))).first()
    usual = {w: c for w, c in sorted(map(tuple, found))}
    known = sc.broadcast(frozenset(usual))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = known.value
        count: Counter = Counter()
        for b in batches:
            for words, names in zip(b["words"], b["names"]):
                words = words.split(" ")
                is_usual = sum([1 << i for i, w in enumerate(words) if w in often])
                by_rest: dict[int, list[int]] = {}  # only names with the same other words can replace each other
                for m in pickle.loads(names):
                    by_rest.setdefault(m & ~is_usual, []).append(m & is_usual)
                seen = set()
                for rest, few in by_rest.items():
                    for a, c in combinations(few, 2):
                        x = a ^ c
                        if x.bit_count() <= 3:
                            d, e = a & x, c & x
                            if d.bit_count() <= 2 and e.bit_count() <= 2 and (d != a or rest):
                                seen.add((d, e) if d < e else (e, d))
                if seen:
                    told = {d: tuple([w for i, w in enumerate(words) if d >> i & 1]) for d in {d for x in seen for d in x}}
                    count.update({(told[d], told[e]) if told[d] < told[e] else (told[e], told[d]) for d, e in seen})
        rows = [(" ".join(a), " ".join(b), n) for (a, b), n in count.items()]
        yield pd.DataFrame(rows, columns=["a", "b", "n"]).astype({"a": object, "b": object, "n": "int64"})

    seen = ents.select("words", "names").mapInPandas(_collected(pairs), "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    replaced = Counter({(tuple(r[0].split()), tuple(r[1].split())): r[2] for r in seen.filter(F.col("n") >= OMITS * max(USUAL_LEAST, n / USUAL)).collect()})
    vocabulary = Vocabulary(usual, replaced)
    first = sc.broadcast(vocabulary)

    kinds = pa.schema([("iri", pa.string()), ("side", pa.int32()), ("rare", pa.string()), ("plain", pa.bool_()), ("packed", pa.binary()), ("d", pa.string()), ("w", pa.string()), ("n", pa.int64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Profiles, and among them (with a null iri) how often definition words, meanings (d empty) and both come together."""
        v, ids, count = first.value, {"": 0}, Counter()

        def made(rows: int, **cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(rows, f.type) for f in kinds], schema=kinds)

        def counted() -> pa.RecordBatch:
            names = list(ids)
            out = made(len(count), d=[names[k >> 32] for k in count], w=[names[k & 0xFFFFFFFF] for k in count], n=list(count.values()))
            count.clear()
            return out

        for b in batches:
            iris, sides, words, names, defs = (b[c].to_pylist() for c in ("iri", "side", "words", "names", "defs"))
            rare, plain, packed, left, right = [], [], [], [], []
            for words_, names_, defs_ in zip(words, names, defs):
                core, few, whole, odd, common = v.profile(words_.split(" "), pickle.loads(names_))
                defs_ = defs_.split()
                rare.append(" ".join([*few, *odd]))
                plain.append(common)
                packed.append(pickle.dumps((core, few, whole, odd, common, defs_)))
                left.append([0, *[ids.setdefault(d, len(ids)) for d in defs_ if d not in few and d not in odd]])
                right.append([0, *[ids.setdefault(w, len(ids)) for w, x in core.items() if x >= 0.5]])
            for k, n in zip(*crossed(left, right)):
                count[k] += n
            yield made(len(iris), iri=iris, side=sides, rare=rare, plain=plain, packed=packed)
            if len(count) > 200_000:
                yield counted()
        yield counted()

    both = write_table(ents.filter("words <> ''").mapInArrow(_collected(build), "iri string, side int, rare string, plain boolean, packed binary, d string, w string, n bigint"), "match-profiles").df
    built = both.filter("iri IS NOT NULL").select("iri", "side", "rare", "plain", "packed")
    told = both.filter("iri IS NULL AND (d <> '' OR w <> '')").groupBy("d", "w").agg(F.sum("n").alias("n"))
    told = {(r[0], r[1]): r[2] for r in told.filter(F.col("n") >= max(SUPPORT, n / (10 * USUAL))).collect()}
    for (d, w), c in told.items():
        whole = told.get((d, ""), 0)
        if d and w and whole and c >= FORETELLS * whole and c / whole >= LIFT * told.get(("", w), n) / max(n, 1):
            vocabulary.foretold[d] = (*vocabulary.foretold.get(d, ()), w)
    return vocabulary, built, most or 0


def similarity(a: tuple, b: tuple) -> tuple[float, float, float] | None:
    """Similarities in 0..1 of two profiles: meanings, lost meanings, names; less where hardly a rare word is shared,
    but for two plain entities. None where neither shares a rare word with the other's words."""
    (ca, ra, na, oa, pa_, ta), (cb, rb, nb, ob, pb, tb) = a, b
    if pa_ and pb:
        gate = 1.0
    else:
        x = y = 0.0
        for w, c in ra.items():
            if w in rb or w in ob:
                x += c
        for w, c in rb.items():
            if w in ra or w in oa:
                y += c
        if not x and not y:
            return None
        gate = min(1.0, 2 * max(x / ta, y / tb))  # pairs that share half of one's rare words are not held to share more
    both, lost, names = 0, 0.0, 0.0
    for w, c in ca.items():
        if w in cb:
            both += 1
        else:
            lost += c
    for w, c in cb.items():
        if w not in ca:
            lost += c
    for w, c in na.items():
        if w in nb:
            names += min(c, nb[w])
    union = len(ca) + len(cb) - both
    return gate * both / union if union else 0.0, gate * math.exp(-lost) if both else 0.0, gate * min(names, 1.0)


_PAIR = ", ".join(["a string, b string, sa int, sb int", *[f"x{k} double" for k in range(DIMS)]])


def _compared(rows: DataFrame, vocabulary: Vocabulary, by_meanings: bool) -> DataFrame:
    """The pairs of the entities (word, iri, side, packed) that meet under a word, each once, with their similarities.

    In parts they meet under (word, p, q) and have `own`, their part. A pair is made under the first of its shared rare
    words. By meanings `word` is a key of them; a pair is made there if it shares no rare word.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    in_parts = "own" in rows.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * DIMS]
        head = ["a", "b", "sa", "sb", *[f"x{k}" for k in range(DIMS)]]
        out: list[tuple] = []
        group: list[tuple] = []
        at = None

        def meet(p: tuple, q: tuple) -> bool:
            """Whether a pair is made here, of those that meet under pairs of meanings."""
            x, y = p[2][0].keys(), q[2][0].keys()
            both = x & y
            return p[4].isdisjoint(q[4]) and 2 * len(both) > len(x | y) and " ".join(v.ordered(both)[:2]) == at[0]

        def flush() -> Iterator[pa.RecordBatch]:
            if len(group) < 2:
                return
            members = []
            for iri, side, packed, own in group:
                core, rare, names, odd, common, defs = pickle.loads(packed)
                words = rare.keys() | odd if odd else rare.keys()
                members.append((iri, side, (v.foretell(core, defs), rare, names, odd, common, sum(rare.values()) or 1), own, words))
            word, first = at[0], None
            if in_parts and at[1] != at[2]:  # two parts, only across
                first, members = [x for x in members if x[3] == at[1]], [x for x in members if x[3] != at[1]]
            for i, p in enumerate(members):
                for q in members[:i] if first is None else first:
                    if not meet(p, q) if by_meanings else min(p[4] & q[4]) != word:
                        continue
                    (s, t) = (p, q) if p[0] < q[0] else (q, p)
                    x = similarity(s[2], t[2])
                    if x is not None:
                        out.append((s[0], t[0], s[1], t[1], *x))
                if len(out) > 20_000:
                    yield batch()
                    out.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * len(head)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=head)

        names = ("iri", "side", "packed", *(("own",) if in_parts else ()), *by)
        for b in batches:
            for iri, side, packed, *here in zip(*[b[c].to_pylist() for c in names]):
                own = here.pop(0) if in_parts else None
                if here != at:
                    yield from flush()
                    group, at = [], here
                group.append((iri, side, packed, own))
        yield from flush()
        yield batch()

    by = ["word", "p", "q"] if in_parts else ["word"]
    return rows.repartition(*by).sortWithinPartitions(*by, "iri").mapInArrow(_collected(compare), _PAIR)


def _in_parts(keys: DataFrame, size: int) -> DataFrame:
    """(iri, word, own, p, q): the entities of each word (iri, word, n: how many it has) dealt into parts of about `size`, under every two of the parts."""
    dealt = keys.withColumn("parts", F.ceil(F.col("n") / size).cast("int")).withColumn("own", F.pmod(F.xxhash64("iri"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("iri", "word", "own", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"))


def _under_meanings(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(iri, side, packed) rows under each key of their meanings, in parts."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for b in batches:
            out = []
            for iri, packed in zip(b["iri"], b["packed"]):
                core, *_, defs = pickle.loads(packed)
                out += [(iri, k) for k in v.keys(v.foretell(core, defs))]
            yield pd.DataFrame(out, columns=["iri", "word"]).astype(object)

    keys = write_table(rows.select("iri", "packed").mapInPandas(keyed, "iri string, word string"), "match-keys").df
    counts = keys.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _in_parts(keys.join(counts, "word"), PART).join(rows, "iri")


def candidate_pairs(profiles: DataFrame, vocabulary: Vocabulary, most: int) -> DataFrame:
    """(a, b, sa, sb, x0..x2) with a < b: all entities that share a rare word, and plain ones that share none but more than
    half of their meanings, with their similarities, once. No word that isn't usual has more than `most` entities; how many
    a word has decides only whether they meet in parts."""
    rows = profiles.filter("rare <> ''").select(F.explode(F.split("rare", " ")).alias("word"), "iri", "side", "packed")
    crowded = None
    if most > CEILING:
        words = rows.select("iri", "word")
        crowded = write_table(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CEILING), "match-crowded").df
    if crowded is None or crowded.isEmpty():
        pairs = _compared(rows, vocabulary, False)
    else:
        dealt = _in_parts(words.join(crowded, "word"), CEILING).join(profiles.select("iri", "side", "packed"), "iri")
        pairs = _compared(rows.join(crowded, "word", "left_anti"), vocabulary, False).unionByName(_compared(dealt, vocabulary, False))
    plain = profiles.filter("plain").select("iri", "side", "packed")
    return pairs if plain.isEmpty() else pairs.unionByName(_compared(_under_meanings(plain, vocabulary), vocabulary, True))


class Mixture:
    """Matched and unmatched Gaussians over similarity vectors."""

    def __init__(self, prior: float, means: np.ndarray, covs: np.ndarray):
        self.prior, self.means, self.covs = prior, means, covs

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """P(matched | x). Similarities beyond the matched mean count as the mean: more alike is never less likely."""
        logs = []
        for k in (0, 1):
            z = np.minimum(x, self.means[1]) if k else x
            z = np.maximum(x, self.means[0]) if k == 0 else z
            inv, (_, det) = np.linalg.inv(self.covs[k]), np.linalg.slogdet(self.covs[k])
            d = z - self.means[k]
            logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, inv, d) - 0.5 * det + math.log(max(self.prior if k else 1 - self.prior, 1e-12)))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))

    @staticmethod
    def from_sums(n: np.ndarray, s: np.ndarray, ss: np.ndarray, strength: float = 0.15) -> Mixture:
        """Maximisation from weighted sums of each component, regularised by the distance of the means."""
        n = np.maximum(n, 1e-6)
        means = s / n[:, None]
        gap = np.maximum((means[1] - means[0]) ** 2, 1e-4)
        covs = np.array([ss[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)])
        for k in (0, 1):
            covs[k] = covs[k] + np.diag(strength * gap + 1e-6)
        return Mixture(float(n[1] / n.sum()), means, covs)

    def column(self) -> Column:
        """`posterior` as an expression over x0, x1, ..."""
        logs = []
        for k in (0, 1):
            at = [F.least(F.col(f"x{i}"), F.lit(float(self.means[1][i]))) if k else F.greatest(F.col(f"x{i}"), F.lit(float(self.means[0][i]))) for i in range(DIMS)]
            d = [x - F.lit(float(self.means[k][i])) for i, x in enumerate(at)]
            inv, (_, det) = np.linalg.inv(self.covs[k]), np.linalg.slogdet(self.covs[k])
            q = sum((F.lit(float(inv[i, j])) * d[i] * d[j] for i in range(DIMS) for j in range(DIMS)), F.lit(0.0))
            logs.append(-0.5 * q + F.lit(float(-0.5 * det + math.log(max(self.prior if k else 1 - self.prior, 1e-12)))))
        return 1 / (1 + F.exp(F.least(F.greatest(logs[0] - logs[1], F.lit(-50.0)), F.lit(50.0))))


def fit(x: np.ndarray, count: np.ndarray, cap: np.ndarray, model: Mixture | None, steps: int) -> Mixture | None:
    """Expectation-maximisation over counted vectors with capped posteriors; `model` as far as it comes where a component is empty."""
    for _ in range(steps):
        g = (x.mean(axis=1) >= 0.75).astype(float) if model is None else model.posterior(x)
        g = np.minimum(g, cap)
        w = np.stack([(1 - g) * count, g * count])
        if w.sum(axis=1).min(initial=np.inf) < 1:
            break
        new = Mixture.from_sums(w.sum(axis=1), w @ x, np.einsum("kn,ni,nj->kij", w, x, x))
        still = model is not None and np.abs(new.means - model.means).max() < 1e-4
        model = new
        if still:
            break
    return model


def _cells(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, counts and caps of all pairs on the grid: at most (GRID + 1)^DIMS (CAPS + 1) rows, however many pairs."""
    grid = [F.round(F.col(f"x{k}") * GRID).cast("int").alias(f"i{k}") for k in range(DIMS)]
    cells = pairs.groupBy(*grid, F.round(F.col("cap") * CAPS).cast("int").alias("ic")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    cells = cells.sort_values([*[f"i{k}" for k in range(DIMS)], "ic"])
    return cells[[f"i{k}" for k in range(DIMS)]].to_numpy(dtype=float) / GRID, cells["n"].to_numpy(dtype=float), cells["ic"].to_numpy(dtype=float) / CAPS


def _caps(scored: DataFrame, least: float = 0.1) -> DataFrame:
    """(a, b, limit): what transitivity allows for pairs that violate it.

    Each entity's best partner p is its pivot; another partner c may match it only as far as p and c
    match. One pivot per entity keeps the number of triangles at the number of matched pairs.
    """
    ends = scored.filter("g >= 0.5").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "g"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "g"))).alias("e")).select("e.*")
    best = Window.partitionBy("u").orderBy(F.desc("g"), F.desc("v"))
    tri = ends.withColumns({"p": F.first("v").over(best), "gp": F.first("g").over(best)}).filter("v <> p").select("u", "v", "gp", F.least("p", "v").alias("a"), F.greatest("p", "v").alias("b"))
    third = tri.join(scored.filter(F.col("g") > least).select("a", "b", F.col("g").alias("g3")), ["a", "b"], "left")
    limit = F.greatest(F.coalesce("g3", F.lit(0.0)), F.lit(least)) / F.col("gp")
    out = third.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), limit.alias("limit"))
    return out.groupBy("a", "b").agg(F.min("limit").alias("limit")).filter("limit < 1")


def match(ents: DataFrame, rounds: int = 2, steps: int = 12) -> DataFrame:
    """(a, b, sa, sb, x0..x2, posterior), a < b: every candidate pair, within a source too, with its confidence.

    Every round fits the mixture under the caps so far and caps the posteriors by transitivity, the last one too.
    Entities without a name take part in no pair. Without any pair, or without both kinds of pair,
    the table is empty or keeps the start's split. Nothing is labelled by hand and nothing is random.
    """
    ents = write_table(ents, "match-entities").df
    vocabulary, profiles, most = learn(ents)
    pairs = write_table(candidate_pairs(profiles, vocabulary, most).withColumn("cap", F.lit(1.0)), "match-pairs").df
    model, start = None, F.when(sum(F.col(f"x{k}") for k in range(DIMS)) >= 0.75 * DIMS, F.lit(1.0)).otherwise(F.lit(0.0))
    for turn in range(rounds):
        model = fit(*_cells(pairs), model, steps if model is None else steps // 3)
        if model is None:
            return pairs.withColumn("posterior", start).drop("cap")
        scored = pairs.withColumn("g", F.least(model.column(), F.col("cap")))
        strong = scored.filter("g >= 0.5").join(_caps(scored), ["a", "b"], "left").withColumn("cap", F.least("cap", F.coalesce("limit", F.lit(1.0)))).drop("limit")
        limited = strong.unionByName(scored.filter("g < 0.5"))  # only matched pairs are capped
        if turn == rounds - 1:
            return limited.withColumn("posterior", F.least("g", "cap")).drop("g", "cap")
        pairs = write_table(limited.drop("g"), "match-pairs").df
    raise AssertionError
