"""Reading level of each document: regularised ordinal regression.

One pass cleans a document of layout (markup, bullets, headers, broken lines, encoding damage, decomposed
accents), splits it into words and counts its marks; everything after works on those. Measures are rates over
the words, so that neither length nor layout nor lost stops move the level: length of words, their rarity in
the whole corpus, lexical diversity, pronouns, connectives and subordination, commas, brackets and words a stop
as proxies of clause depth. How demanding a word is comes from the graded text, not from a list: the mean
grade of the graded documents that hold it, for connectives (closed classes and very frequent words) and for
other words apart. A proportional-odds model with an L2 penalty turns the measures into a level; its
thresholds come from the graded documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.materialize import write_table

#: Words with more than 1/COMMON of all occurrences are listed with their frequency (at most COMMON of them);
#: the others are equally rare. Those with more than 1/FREQUENT of all occurrences are very frequent.
COMMON, FREQUENT = 20_000, 500
#: Graded documents the model is fitted on, the first by hash; a documented bound, far above a usual set.
MOST_GRADED = 20_000
#: Words whose measures a task remembers, and words measured at a time.
REMEMBERED, AT_ONCE = 500_000, 300_000

# Closed classes of English and French grammar, and the commonest words of both to tell them apart.
PRONOUNS = "i me my mine you your yours he him his she her hers we us our ours they them their theirs je me moi mon ma mes tu te toi ton ta tes nous notre nos vous votre vos".split()
COORDINATORS = "and or but so yet et ou mais donc".split()
SUBORDINATORS = "that which who whom whose where when while if whether because since although though unless until as than before after once qui que dont lorsque quand si comme puisque quoique parce afin tandis".split()
ADVERBS = "however therefore moreover thus hence nevertheless furthermore consequently otherwise instead also then cependant ainsi toutefois neanmoins pourtant alors enfin puis aussi".split()
_CLASSES = [frozenset(x) for x in (PRONOUNS, COORDINATORS, SUBORDINATORS, ADVERBS)]
_ENGLISH = frozenset("the of and to is in that it not for with are be this its by or from can you".split())
_FRENCH = frozenset("le la les des de du et est un une en que qui pas au dans par ne sur il se".split())

_TAG = re.compile(r"<[^<>]{0,200}>")
_BULLET = re.compile(r"^[ \t]*(?:[-*•·–—>]+|\d+[.)]|#+)[ \t]+", re.M)
_PAGE = re.compile(r"^\W*(?:page|p\.)\s*\d+.*$", re.M | re.I)
_REF = re.compile(r"[\[(][^\])]{0,60}(?:ref|fig|cf|draft|release|translated|p\. \d)[^\])]{0,60}[\])]", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?;:]+(?=\s|$)")
_VOWELS = re.compile(r"[aeiouy]+")
_MOJIBAKE = re.compile(r"[ÃÂâ][\x80-\xbf‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿€]")
_LETTERS = {i: (chr(i).lower() if chr(i).isalpha() else " ") for i in range(128)}


def clean(text: str) -> str:
    """Text without layout: composed accents, damage by a wrong decoding undone. White space is left as it is."""
    if not text.isascii():
        if _MOJIBAKE.search(text):
            fixed = []
            for word in text.split(" "):
                try:
                    fixed.append(word.encode("cp1252").decode("utf-8"))
                except (UnicodeEncodeError, UnicodeDecodeError):
                    fixed.append(word)
            text = " ".join(fixed)
        text = unicodedata.normalize("NFC", text)
    if "<" in text:
        text = _TAG.sub(". ", text)
    text = _BULLET.sub(" ", text)
    if "age" in text or "AGE" in text or "p." in text or "P." in text:
        text = _PAGE.sub(" ", text)
    return _REF.sub(" ", text) if "(" in text or "[" in text else text


def words_of(text: str) -> list[str]:
    """Lower-case words without accents; apostrophes split."""
    if text.isascii():
        return text.translate(_LETTERS).split()
    return _WORD.findall("".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)))


MARKS = ["commas", "semicolons", "brackets", "stops"]


def parse(text: str | None) -> tuple[list[str], list[int]]:
    """(words, counts of MARKS) of a text; no words for a null one."""
    if not text:
        return [], [0, 0, 0, 0]
    body = clean(text)
    return words_of(body), [body.count(","), body.count(";") + body.count(":"), body.count("(") + body.count("["), len(_STOP.findall(body)) + 1]


#: By word: rates over a document's words, then sums that are no measures by themselves.
_RATES = ["word_len", "long8", "long12", "syllables", "rarity", "unlisted", "pronouns", "coordinators", "subordinators", "adverbs", "frequent"]
_SUMS = ["register", "registered", "grade", "graded", "english", "french"]
MEASURES = [*_RATES, "register", "grade", "diversity", *[f"{m}_rate" for m in MARKS[:3]], "words_a_stop"]


class Lexicon:
    """What the measures need to know of a word, computed once for each and remembered."""

    def __init__(self, rarity: dict[str, float], graded: dict[str, float]):
        self.rarity, self.graded, self.top = rarity, graded, math.log(COMMON)
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(_RATES) + len(_SUMS)), dtype=np.float32)

    def row(self, w: str) -> list[float]:
        r = self.rarity.get(w)
        frequent = r is not None and r < math.log(FREQUENT)
        classes = [w in c for c in _CLASSES]
        connective, g = frequent or any(classes), self.graded.get(w)
        own = [0.0 if g is None else g, g is not None]
        return [len(w), len(w) >= 8, len(w) >= 12, len(_VOWELS.findall(w)), self.top if r is None else r, r is None, *classes, frequent, *(own if connective else [0, 0]), *([0, 0] if connective else own), w in _ENGLISH, w in _FRENCH]

    def codes(self, words: list[str]) -> list[int]:
        at = self.at
        for w in words:
            if w not in at:
                if len(at) == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[len(at)] = self.row(w)
                at[w] = len(at)
        return [at[w] for w in words]

    def measures(self, docs: list[list[str]], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(measures in the order of MEASURES, whether French) of documents with words."""
        if len(self.at) > REMEMBERED:
            self.__init__(self.rarity, self.graded)
        codes = [self.codes(d) for d in docs]
        n = np.array([len(c) for c in codes], dtype=float)
        diversity = np.array([len(set(c)) for c in codes]) / np.sqrt(2 * n)
        flat = np.fromiter((x for c in codes for x in c), np.int64, int(n.sum()))
        sums = np.add.reduceat(self.rows[flat], (np.cumsum(n) - n).astype(int), axis=0, dtype=float)
        rates, rest = sums[:, : len(_RATES)] / n[:, None], dict(zip(_SUMS, sums[:, len(_RATES) :].T))
        learned = [rest["register"] / (rest["registered"] + 1), rest["grade"] / (rest["graded"] + 1)]
        by_stop = np.log(np.minimum(n / np.maximum(marks[:, 3], 1), 60))
        return np.column_stack([rates, *learned, diversity, marks[:, :3] / n[:, None], by_stop]), rest["french"] > rest["english"]


@dataclass
class OrdinalModel:
    """Proportional odds: P(band <= k) = sigmoid(cut_k - w.x), x standardised."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def level(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Rows x bands."""
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - self.level(x)[:, None], -40, 40)))
        edge = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        return np.diff(edge, axis=1)


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bands: int, penalty: float = 1.0, steps: int = 3000) -> OrdinalModel:
    """Weighted maximum likelihood with an L2 penalty on the standardised weights, by Adam."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.clip((x - mean) / scale, -6, 6)
    w = np.zeros(x.shape[1])
    first, gaps = -1.0, np.zeros(bands - 2)
    theta = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for t in range(1, steps + 1):
        w, cuts = theta[: x.shape[1]], np.concatenate([[theta[x.shape[1]]], theta[x.shape[1]] + np.cumsum(np.exp(theta[x.shape[1] + 1 :]))])
        eta = z @ w
        ext = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = 1 / (1 + np.exp(-np.clip(ext[y + 1] - eta, -40, 40))), 1 / (1 + np.exp(-np.clip(ext[y] - eta, -40, 40)))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        g_eta = weight * (dhi - dlo) / p / total
        grad_w = z.T @ g_eta + penalty * w / total
        g_cut = np.zeros(bands - 1)
        for k in range(bands - 1):
            g_cut[k] = -(weight * (y == k) * dhi / p).sum() / total + (weight * (y == k + 1) * dlo / p).sum() / total
        gap = np.exp(theta[x.shape[1] + 1 :])
        grad = np.concatenate([grad_w, [g_cut.sum()], [g_cut[k + 1 :].sum() * gap[k] for k in range(bands - 2)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    cuts = np.concatenate([[theta[x.shape[1]]], theta[x.shape[1]] + np.cumsum(np.exp(theta[x.shape[1] + 1 :]))])
    return OrdinalModel(mean, scale, theta[: x.shape[1]], cuts)


def grade_words(docs: list[list[str]], y: np.ndarray, weight: np.ndarray, middle: float, least: int = 2, prior: float = 2.0) -> dict[str, float]:
    """Mean grade of the documents a word is in, minus the middle, shrunk towards 0; words in fewer than `least` are left out."""
    total: Counter = Counter()
    seen: Counter = Counter()
    for words, g, c in zip(docs, y, weight):
        for w in set(words):
            total[w] += (g - middle) * c
            seen[w] += c
    return {w: total[w] / (seen[w] + prior) for w in seen if seen[w] >= least}


def design(docs: list[list[str]], marks: np.ndarray, y: np.ndarray, weight: np.ndarray, middle: float, rarity: dict[str, float], inner: int = 5) -> tuple[dict[str, float], np.ndarray]:
    """Graded words of all documents, and each document's measures with the grades of the other documents only."""
    x = np.zeros((len(docs), len(MEASURES)))
    fold = np.arange(len(docs)) % inner
    for k in range(inner):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own):
            x[own] = Lexicon(rarity, grade_words([docs[i] for i in rest], y[rest], weight[rest], middle)).measures([docs[i] for i in own], marks[own])[0]
    return grade_words(docs, y, weight, middle), x


@dataclass
class Grader:
    """A fitted model with what its measures need; `model` is None where the grades make no scale."""

    rarity: dict[str, float]
    graded: dict[str, float]
    scale: list[int]
    model: OrdinalModel | None

    @staticmethod
    def fit(docs: list[list[str]], marks: np.ndarray, grades: np.ndarray, low: int, high: int, weight: np.ndarray, rarity: dict[str, float], penalty: float = 1.0) -> Grader:
        """`grades` are means over annotators, `weight` their number; `low` and `high` the ends of the scale given."""
        y = np.clip(np.floor(grades + 0.5), low, high).astype(int)
        scale = sorted(set(y.tolist()))
        if len(scale) < 2:
            return Grader(rarity, {}, [], None)
        graded, x = design(docs, marks, y.astype(float), weight, (low + high) / 2, rarity)
        return Grader(rarity, graded, scale, fit_ordinal(x, np.searchsorted(scale, y), weight, len(scale), penalty))


def _parsed(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, words, marks) of every document and (word, n) of the corpus, from one pass over the texts."""
    ident = dict(base.dtypes)["id"]
    schema = f"id {ident}, doc boolean, words string, marks array<int>, word string, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def made(ids: pa.Array, words: list, marks: list, word: list, n: list) -> pa.RecordBatch:
            cols = [ids, pa.array([w is None for w in word]), pa.array(words, pa.string()), pa.array(marks, pa.list_(pa.int32())), pa.array(word, pa.string()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["id", "doc", "words", "marks", "word", "n"])

        for b in batches:
            words, marks = [], []
            for text in b["text"].to_pylist():
                w, m = parse(text)
                count.update(w)
                words.append(" ".join(w))
                marks.append(m)
            yield made(b["id"], words, marks, [None] * len(words), [None] * len(words))
            if len(count) > REMEMBERED:
                yield made(pa.nulls(len(count), b["id"].type), [None] * len(count), [None] * len(count), list(count), list(count.values()))
                count.clear()
        if count:
            yield made(pa.nulls(len(count), b["id"].type), [None] * len(count), [None] * len(count), list(count), list(count.values()))

    both = write_table(base.mapInArrow(run, schema), "reading-parsed").df
    return both.filter("doc").select("id", "words", "marks"), both.filter("NOT doc").groupBy("word").agg(F.sum("n").alias("n"))


def reading_levels(docs: DataFrame, ident: str, text: str, grades: DataFrame, grade_ident: str, grade: str, penalty: float = 1.0) -> DataFrame:
    """(ident, language, n_words, level, band, p_band): the level on the model's scale, the most likely band of the
    graded scale and its probability. One row per document row.

    A document's grades are averaged and weigh as many as they are; null grades and grades without a
    document count for nothing. Texts that are null or have no word get nulls, and 0 words. With fewer than two
    different grades there is no scale: level and band are null. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    parsed, counts = _parsed(base)
    # bounded: the listed words, at most COMMON, and their total
    total = counts.agg(F.sum("n")).first()[0] or 0
    rarity = {r[0]: math.log(total / r[1]) for r in counts.filter(F.col("n") > max(total / COMMON, 1)).collect()}
    per_doc = grades.filter(F.col(grade).isNotNull() & F.col(grade_ident).isNotNull()).groupBy(F.col(grade_ident).alias("id")).agg(F.avg(grade).alias("g"), F.count(F.lit(1)).alias("c"), F.min(grade).alias("lo"), F.max(grade).alias("hi"))
    per_doc = per_doc.orderBy(F.xxhash64("id")).limit(MOST_GRADED)
    seen = {r["id"]: r for r in parsed.filter("words <> ''").join(F.broadcast(per_doc), "id").collect()}
    known = [seen[k] for k in sorted(seen)]
    grader = Grader(rarity, {}, [], None)
    if known:
        grader = Grader.fit([r["words"].split() for r in known], np.array([r["marks"] for r in known]), np.array([float(r["g"]) for r in known]), min(r["lo"] for r in known), max(r["hi"] for r in known), np.array([r["c"] for r in known], dtype=float), rarity, penalty)
    shared = spark.sparkContext.broadcast(grader)
    schema = "id {}, language string, n_words int, level double, band int, p_band double".format(dict(base.dtypes)["id"])
    names, kinds = ["id", "language", "n_words", "level", "band", "p_band"], [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.float64()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        lexicon, scale = Lexicon(g.rarity, g.graded), np.array(g.scale)
        for b in batches:
            texts, marks = [w.split() for w in b["words"].to_pylist()], np.array(b["marks"].to_pylist(), dtype=float).reshape(-1, len(MARKS))
            n = np.array([len(w) for w in texts])
            cols: list[list] = [[None] * len(texts) for _ in range(5)]
            cols[1] = n.tolist()
            has = np.flatnonzero(n)
            ends = np.searchsorted(np.cumsum(n[has]), np.arange(AT_ONCE, n.sum() + AT_ONCE, AT_ONCE))
            for part in np.split(has, np.unique(ends[ends < len(has)])):
                if not len(part):
                    continue
                x, french = lexicon.measures([texts[i] for i in part], marks[part])
                p = level = best = None
                if g.model is not None:
                    prob = g.model.probabilities(x)
                    level, best, p = g.model.level(x).tolist(), scale[prob.argmax(axis=1)].tolist(), prob.max(axis=1).tolist()
                for k, i in enumerate(part.tolist()):
                    cols[0][i] = "fr" if french[k] else "en"
                    if p is not None:
                        cols[2][i], cols[3][i], cols[4][i] = level[k], best[k], p[k]
            yield pa.RecordBatch.from_arrays([b["id"], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    return parsed.mapInArrow(score, schema).withColumnRenamed("id", ident)
