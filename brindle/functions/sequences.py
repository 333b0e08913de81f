"""Functions of two strings that need dynamic programming: plain functions and Arrow-batched columns.

Equal pairs within a batch are computed once. Nulls count as ''.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from brindle.functions.normal import strip_accents_py


def _positions(a) -> dict:
    """Of each element, the bits of the places it has in a."""
    out: dict = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _edits(a: str, b: str, swaps: bool, at: dict | None = None) -> int:
    """Edit distance by bit-parallel columns: one bit per character of a tells whether the cell below is one more or one less."""
    if not a or not b:
        return len(a) + len(b)
    at, full, high, n = _positions(a) if at is None else at, (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less, diagonal, last = full, 0, full, 0
    for ch in b:
        eq = at.get(ch, 0)
        swap = ((~diagonal & eq) << 1) & last if swaps else 0
        diagonal = (((eq & more) + more) ^ more | eq | less | swap) & full
        up, down = less | ~(diagonal | more) & full, more & diagonal
        n += bool(up & high) - bool(down & high)
        up, down = (up << 1 | 1) & full, down << 1 & full
        more, less, last = down | ~(diagonal | up) & full, up & diagonal, eq
    return n


def levenshtein(a: str, b: str) -> int:
    """Edit distance."""
    return _edits(a, b, False)


def osa(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, no part edited twice."""
    return _edits(a, b, True)


def lcs(a, b, at: dict | None = None) -> int:
    """Length of the longest common subsequence of two sequences."""
    at, full = _positions(a) if at is None else at, (1 << len(a)) - 1
    free = full
    for x in b:
        hit = free & at.get(x, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def jaro(a: str, b: str, at: dict | None = None) -> float:
    """Jaro similarity; 1 for two empty texts. The free places of b are bits, so the nearest equal one is the lowest."""
    if not a or not b:
        return float(a == b)
    at = _positions(b) if at is None else at
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    near, free, hits = (1 << (reach + 1)) - 1, (1 << len(b)) - 1, []
    for i, ch in enumerate(a):
        hit = at.get(ch, 0) & free & near
        if hit:
            free ^= hit & -hit
            hits.append(ch)
        near = near << 1 | 1 if i < reach else near << 1
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum([x != y for x, y in zip(hits, [y for j, y in enumerate(b) if not free >> j & 1])]) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1, most: int = 4) -> float:
    """Jaro, raised by the common prefix whatever its value is."""
    j = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:most], b[:most]):
        if x != y:
            break
        prefix += 1
    return j + prefix * weight * (1 - j)


def bleu(reference: str, candidate: str, most: int = 4, smooth: bool = True) -> float:
    """Sentence BLEU with add-one smoothing of orders without a hit."""
    ref, cand = reference.lower().split(), candidate.lower().split()
    if not ref or not cand:
        return 0.0
    logs = []
    for n in range(1, min(most, len(cand)) + 1):
        grams = Counter(zip(*[cand[k:] for k in range(n)]))
        known = Counter(zip(*[ref[k:] for k in range(n)]))
        hits, total = sum((grams & known).values()), sum(grams.values())
        if not hits and not smooth:
            return 0.0
        logs.append(math.log(hits / total if hits else 1 / (total + 1)))
    brevity = math.exp(1 - len(ref) / len(cand)) if len(cand) <= len(ref) else 1.0
    return brevity * math.exp(sum(logs) / len(logs))


def rouge_l(reference: str, candidate: str) -> tuple[float, float, float]:
    """Precision, recall and F1 of the longest common subsequence of words."""
    ref, cand = reference.lower().split(), candidate.lower().split()
    if not ref or not cand:
        return 0.0, 0.0, 0.0
    n = lcs(ref, cand)
    p, r = n / len(cand), n / len(ref)
    return p, r, 2 * p * r / (p + r) if n else 0.0


def gestalt(a: str, b: str) -> float:
    """Ratio of matching blocks, as the standard library's difflib defines it."""
    return SequenceMatcher(None, a, b).ratio()


def _column(f: Callable, kind) -> Callable[[Column, Column], Column]:
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out)

    return F.pandas_udf(batch, kind)


osa_col = _column(osa, IntegerType())
lcs_col = _column(lcs, IntegerType())
jaro_col = _column(jaro, DoubleType())
jaro_winkler_col = _column(jaro_winkler, DoubleType())
bleu_col = _column(bleu, DoubleType())
gestalt_col = _column(gestalt, DoubleType())



def _struct(f: Callable, names: list[str]) -> Callable[[Column, Column], Column]:
    kind = StructType([StructField(n, DoubleType()) for n in names])

    def batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in known:
                known[pair] = f(*pair)
            rows.append(known[pair])
        return pd.DataFrame(rows, columns=names, dtype="float64")

    return F.pandas_udf(batch, kind)



def cosine_grams(n: int) -> Callable[[Column, Column], Column]:
    """Cosine of the character n-gram counts of two normalized texts, blanks removed."""
    grams = lambda s: [s[i : i + n] for i in range(len(s) - n + 1)]
    return _column(lambda a, b: _count_cosine(grams(a.replace(" ", "")), grams(b.replace(" ", ""))), DoubleType())


rouge_l_col = _struct(rouge_l, ["p", "r", "f"])

# Names and order of the label similarity columns.
SYNTAX = [
    "syn_len_a", "syn_len_b", "syn_equal_exact", "syn_equal_casefold", "syn_contains_a_in_b", "syn_contains_b_in_a",
    "syn_levenshtein", "syn_levenshtein_sim", "syn_damerau_osa", "syn_damerau_osa_sim", "syn_lcs_len", "syn_lcs_ratio",
    "syn_common_prefix_ratio", "syn_common_suffix_ratio", "syn_jaccard_tokens", "syn_dice_tokens", "syn_jaccard_bigrams",
    "syn_jaccard_trigrams", "syn_cosine_bigrams", "syn_cosine_trigrams", "syn_jaro", "syn_jaro_winkler",
]
NLP = ["nlp_bleu", *[f"nlp_rouge{n}_{x}" for n in ("1", "2", "L") for x in "prf"]]


_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


def _norm(s: str) -> str:
    if s.isascii():
        return " ".join(s.translate(_ASCII).split())
    low = strip_accents_py(s).lower()
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in low).split())


class _Text:
    """What the similarities need of one label, computed once however many pairs it is in."""

    __slots__ = ("raw", "fold", "norm", "back", "at", "words", "grams")

    def __init__(self, raw: str):
        self.raw, self.fold, self.norm = raw, raw.casefold(), _norm(raw)
        self.back, self.at, self.words = self.norm[::-1], _positions(self.norm), set(self.norm.split())
        solid = self.norm.replace(" ", "")
        self.grams = {}
        for n in (2, 3):
            count = Counter([solid[i : i + n] for i in range(len(solid) - n + 1)])
            self.grams[n] = count, sum([c * c for c in count.values()])


def _set_sims(a, b) -> tuple[float, float]:
    """Jaccard and Dice of two sets (or the keys of two counters), 1 where both are empty."""
    if not a and not b:
        return 1.0, 1.0
    n = len(a & b)
    return n / (len(a) + len(b) - n), 2 * n / (len(a) + len(b))


def _gram_sims(x: tuple, y: tuple) -> tuple[float, float]:
    """Jaccard and cosine of two counters with their sums of squares."""
    (a, p), (b, q) = x, y
    if not a or not b:
        both = float(not a and not b)
        return both, both
    shared, dot = 0, 0
    for k, n in (a if len(a) <= len(b) else b).items():
        m = (b if len(a) <= len(b) else a).get(k)
        if m:
            shared += 1
            dot += n * m
    return shared / (len(a) + len(b) - shared), dot / math.sqrt(p * q)


def _count_cosine(x: list, y: list) -> float:
    a, b = Counter(x), Counter(y)
    if not a or not b:
        return float(not a and not b)
    return sum(n * b[k] for k, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _syntax(x: _Text, y: _Text) -> list[float]:
    a, b = x.norm, y.norm
    size = max(len(a), len(b), 1)
    lev, dam, sub = (_edits(a, b, False, x.at), _edits(a, b, True, x.at), lcs(a, b, x.at)) if a and b else (len(a) + len(b), len(a) + len(b), 0)
    pre = _prefix(a, b)
    two, three, j = _gram_sims(x.grams[2], y.grams[2]), _gram_sims(x.grams[3], y.grams[3]), jaro(a, b, y.at)
    return [float(v) for v in (
        len(a), len(b), x.raw == y.raw, x.fold == y.fold, bool(a) and a in b, bool(b) and b in a,
        lev, 1 - lev / size, dam, 1 - dam / size, sub, sub / size, pre / size, _prefix(x.back, y.back) / size,
        *_set_sims(x.words, y.words), two[0], three[0], two[1], three[1], j, j + min(4, pre) * 0.1 * (1 - j),
    )]


def syntax_row(raw_a: str, raw_b: str) -> list[float]:
    """The label similarities of one pair, in the order of SYNTAX."""
    return _syntax(_Text(raw_a), _Text(raw_b))


def _syntax_batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    texts: dict[str, _Text] = {}
    known: dict = {}
    rows = []
    for pair in zip(a.fillna(""), b.fillna("")):
        row = known.get(pair)
        if row is None:
            x, y = (texts.get(t) or texts.setdefault(t, _Text(t)) for t in pair)
            row = known[pair] = _syntax(x, y)
        rows.append(row)
    return pd.DataFrame(rows, columns=SYNTAX, dtype="float64")


def nlp_row(reference: str, candidate: str) -> list[float]:
    """BLEU and ROUGE of one pair, in the order of NLP."""
    ref, cand = reference.lower().split(), candidate.lower().split()
    out = [bleu(reference, candidate)]
    for n in (1, 2):
        a, b = set(zip(*[ref[k:] for k in range(n)])), set(zip(*[cand[k:] for k in range(n)]))
        p, r = (len(a & b) / len(b), len(a & b) / len(a)) if a and b else (0.0, 0.0)
        out += [p, r, 2 * p * r / (p + r) if p + r else 0.0]
    return [*out, *rouge_l(reference, candidate)]


syntax_col = F.pandas_udf(_syntax_batch, StructType([StructField(n, DoubleType()) for n in SYNTAX]))
nlp_col = _struct(nlp_row, NLP)
