"""Scalar functions against plain versions and known values."""

import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import clouds as C
from brindle.functions import sequences as S
from brindle.functions import text as T
from brindle.functions import vector as V
from brindle.functions.normal import normal_form, normal_form_py, normalize_text

PAIRS = [("diabetes mellitus", "diabetes mellitus type 2"), ("heart failure", "cardiac failure"), ("Alzheimer disease", "Alzheimer's disease"), ("COVID-19", "coronavirus disease 2019"), ("", ""), ("", "a"), ("é", "e"), ("type 1", "type 2"), ("camelCase", "camel case"), ("x" * 250, "x" * 249 + "y")]


def table(a, b, swaps):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def test_edit_distances():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in "xy")
        assert (S.levenshtein(a, b), S.osa(a, b), S.lcs(a, b)) == (table(a, b, False), table(a, b, True), longest(a, b))
        assert S.osa(a, b) == S.osa(b, a) <= S.levenshtein(a, b)
    assert S.osa("ca", "abc") == 3


def test_jaro():
    assert S.jaro("", "") == 1.0 and S.jaro("", "a") == 0.0
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro_winkler("abcd", "axyz") == pytest.approx(0.55)


def test_bleu_and_rouge():
    assert S.bleu("a b c", "") == 0.0 and S.bleu("the cat sat down", "the cat sat down") == pytest.approx(1.0)
    assert S.bleu("a b", "a") == pytest.approx(math.exp(-1)) and S.bleu("x y", "a", smooth=False) == 0.0
    assert S.rouge_l("a b c d", "a c") == (1.0, 0.5, pytest.approx(2 / 3)) and S.rouge_l("", "a") == (0.0, 0.0, 0.0)


def test_bundles(spark):
    df = spark.createDataFrame([*PAIRS, (None, "a")], "a string, b string")
    got = df.withColumn("x", S.syntax_col("a", "b")).withColumn("y", S.nlp_col("a", "b")).collect()
    for r in got:
        x = r["x"].asDict()
        assert list(x) == S.SYNTAX and list(r["y"].asDict()) == S.NLP
        assert all(0 <= x[c] <= 1 for c in S.SYNTAX if c.split("_")[1] in ("jaccard", "dice", "cosine", "jaro", "equal"))
    assert got[4]["x"]["syn_jaccard_tokens"] == 1.0 and got[6]["x"]["syn_levenshtein"] == 0.0


def test_normal_forms(spark):
    values = ["HeartValve", "Éclair-2A", "  ", "ÀÉ ﬁx½", "abcDefGHI9Jk", None, "naïve"]
    got = spark.createDataFrame([(v,) for v in values], "x string").select(normal_form(F.col("x")), normalize_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [normal_form_py(v) for v in values]
    assert got[0][0] == "heart valve" and got[0][1] == "heartvalve" and got[5][1] == ""


def test_empty_conventions(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c", "c"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    r = df.select(T.jaccard(a, b), T.jaccard(a, b, 1.0), T.dice(a, b, 1.0), T.overlap(a, b), T.cosine_counts(a, b)).collect()
    assert tuple(r[0]) == (0.0, 1.0, 1.0, 0.0, 1.0) and tuple(r[1]) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert r[2][0] == pytest.approx(1 / 3) and r[2][4] == pytest.approx(1 / math.sqrt(10))


def test_char_wb(spark):
    got = spark.createDataFrame([(["ab", "c"],)], "w array<string>").select(T.char_wb_ngrams(F.col("w"), 3, 5)).first()[0]
    assert Counter(got) == Counter([" ab", "ab ", " ab ", " c "])


def test_vectors(spark):
    rng = np.random.default_rng(42)
    rows = [(rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for _ in range(20)] + [([0.0] * 8, [1.0] * 8), ([2.0] * 8, [2.0] * 8), ([1.0, 1.0, 2.0, 2.0] * 2, [3.0, 1.0, 1.0, 3.0] * 2)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    jvm = df.select(V.euclidean(a, b), 1 - V.cosine(a, b), V.cosine(a, b), V.pearson(a, b), V.spearman(a, b), V.minkowski(a, b), V.canberra(a, b), V.chebyshev(a, b)).collect()
    assert np.allclose([list(r) for r in jvm], V.classical_rows([r[0] for r in rows], [r[1] for r in rows]), atol=1e-9)


def test_spectra():
    assert C.spectra(np.zeros((0, 3))) == [0.0] * 5
    x = np.random.default_rng(1).normal(size=(7, 5))
    s = np.linalg.svd(x, compute_uv=False)
    cov = np.linalg.eigvalsh(np.cov(x, rowvar=False))
    p = s / s.sum()
    want = [-np.polyfit(np.log(np.arange(1, 6)), np.log(s), 1)[0], cov.sum() / cov.max(), np.exp(-(p * np.log(p)).sum()), (s**2).sum() / s[0] ** 2, (5 * np.linalg.norm(x @ x.T) - 7 * 11) / (4 * 6 * 7)]
    assert np.allclose(C.spectra(x), want)


def test_homology():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], dtype=float)
    (h0, h1, h2), cut = C.diagrams(square, top=2)
    assert h0.tolist() == [[0, 1], [0, 1], [0, 1], [0, math.inf]] and np.allclose(h1, [[1, math.sqrt(2)]]) and len(h2) == 0 and not cut
    octahedron = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], dtype=float)
    assert np.allclose(C.diagrams(octahedron, top=2)[0][2], [[math.sqrt(2), 2]])
    assert C.diagrams(np.random.default_rng(0).normal(size=(60, 3)))[1]
    assert C.persistence_entropy(h0) == pytest.approx(math.log2(3)) and C.total_persistence(h0) == 3


def test_diagram_distances():
    rng = np.random.default_rng(2)
    for _ in range(10):
        cost = rng.random((5, 5))
        assert sum(cost[i, j] for i, j in enumerate(C._assignment(cost))) == pytest.approx(min(sum(cost[i, p[i]] for i in range(5)) for p in permutations(range(5))))
        a, b = (np.sort(rng.random((3, 2)), axis=1) for _ in "xy")
        c = C._cost(a, b)
        ways = [[c[i, p[i]] for i in range(6)] for p in permutations(range(6))]
        assert C.bottleneck(a, b) == pytest.approx(min(max(w) for w in ways)) and C.wasserstein(a, b) == pytest.approx(min(math.sqrt(sum(x * x for x in w)) for w in ways))
    assert C.bottleneck(a, a) == 0 and C.wasserstein(np.zeros((0, 2)), a) == 0


def test_overlap():
    a = np.array([[0.0], [1.0], [5.0]])
    assert C.local_overlap(a, a) == (1.0, 1.0, 1.0) and C.local_overlap(a, a[:1]) == (0.0, 0.0, 0.0)
    assert C.local_overlap(a, a + 100)[0] == 0.0
    assert C.local_overlap(np.eye(3), np.eye(3) * 7, "cosine")[0] == 1.0
