"""Operators with an exact result, against brute force, and their defined edge cases."""

import random
from collections import defaultdict
from fractions import Fraction
from math import comb, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import distinct_terms, median_rank, set_join, splits, top_n
from brindle.llm.common import canonical_iri
from brindle.llm.components import components
from brindle.llm.queries import queries
from brindle.llm.tokens import PATTERN, token_count


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# top n


def best(data, n):
    seen = defaultdict(dict)
    for g, i, s in data:
        if g is not None and i is not None and s is not None and s == s:
            seen[g][i] = max(s, seen[g].get(i, -float("inf")))
    return sorted(((g, i) for g, x in seen.items() for i, _ in sorted(x.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:n]), key=str)


def test_top_n_against_sorting(spark):
    rng = random.Random(3)
    data = [(rng.choice("abcd") if rng.random() > 0.3 else "hot", f"it-{rng.randrange(60):03d}" + "é" * rng.randrange(2), rng.choice([0.5, 0.5, round(rng.uniform(-2, 2), 2), float("inf"), -0.0, 0.0, float("nan"), None, 1e-300, -1e300])) for _ in range(900)]
    data += [(None, "x", 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame([(*r, 1, "z") for r in data], "src string, tgt string, score double, n int, rank string")
    for n in (1, 3, 7):
        out = top_n.top_n(df, "src", "tgt", "score", n)
        assert rows(out.select("src", "tgt")) == best(data, n)
        assert out.columns == ["src", "tgt", "score", "rank"]


def test_top_n_all_tied_and_salted(spark, monkeypatch):
    data = [("g", f"{k:05d}", 0.25) for k in range(400)]
    monkeypatch.setattr(top_n, "hot_keys", lambda c, k: c.select(k, F.lit(5).alias("salts")))
    assert [r[1] for r in rows(top_n.top_n(spark.createDataFrame(data, "g string, i string, s double"), "g", "i", "s", 4).select("g", "i"))] == ["00000", "00001", "00002", "00003"]


def test_top_n_empty(spark):
    assert rows(top_n.top_n(spark.createDataFrame([], "g string, i string, s double"), "g", "i", "s", 2)) == []


def test_score_code_orders(spark):
    v = [float("-inf"), -1e300, -1.5, -1e-320, 0.0, 1e-320, 0.1, 0.10000000000000002, 1e300, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x double").select(top_n.score_code(F.col("x"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


# components


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted(((x, find(x)) for x in list(parent)), key=str)


@pytest.mark.parametrize("kind", ["random", "chain", "hub"])
def test_components(spark, kind):
    rng = random.Random(1)
    if kind == "random":
        pairs = [(f"n{rng.randrange(90):02d}", f"n{rng.randrange(90):02d}") for _ in range(60)] + [(None, "n01"), ("n02", None), ("zz", "zz")]
    elif kind == "chain":
        order = list(range(70))
        rng.shuffle(order)
        pairs = [(f"c{a:02d}", f"c{b:02d}") for a, b in zip(order, order[1:])]
    else:
        pairs = [("m", f"x{k}") for k in range(60)] * 2
    df = spark.createDataFrame([(*p, 1) for p in pairs], "a string, b string, u int")
    assert rows(components(df, "a", "b")) == union_find(pairs)


def test_components_empty(spark):
    assert rows(components(spark.createDataFrame([], "a string, b string"), "a", "b")) == []


# median rank


def brute_ranks(data, k):
    groups = defaultdict(dict)
    for g, i, *s in data:
        if g is None or i is None:
            continue
        old = groups[g].get(i, [None] * k)
        groups[g][i] = [max((x for x in (o, v) if x is not None and x == x), default=None) for o, v in zip(old, s)]
    out = {}
    for g, items in groups.items():
        key = lambda v: (v is not None, v if v is not None else 0)
        ranks = {i: [1 + sum(key(o[c]) > key(v[c]) for o in items.values()) for c in range(k)] for i, v in items.items()}
        order = sorted(items, key=lambda i: (sorted(ranks[i])[(k - 1) // 2], sum(ranks[i]), i))
        for p, i in enumerate(order, 1):
            out[g, i] = (*ranks[i], sorted(ranks[i])[(k - 1) // 2], p)
    return groups, out


def score_rows(rng, n):
    v = lambda: rng.choice([None, float("nan"), 0.5, 0.5, rng.uniform(-9, 9), float("inf")])
    return [(rng.choice(["a", "b", "hot", "hot", "hot"]), f"i{rng.randrange(70)}", v(), v(), v()) for _ in range(n)] + [(None, "x", 1.0, 1.0, 1.0), ("solo", "i", None, None, None)]


@pytest.mark.parametrize("hot_from", [20_000, 10])
def test_median_rank(spark, hot_from):
    data = score_rows(random.Random(5), 300)
    df = spark.createDataFrame([(*r, 7, 8) for r in data], "g string, i string, s double, b double, flat double, n int, place int")
    _, want = brute_ranks(data, 3)
    got = median_rank.rank_items(df, "g", "i", ["s", "b", "flat"], hot_from=hot_from)
    assert {(r["g"], r["i"]): (r["rank_s"], r["rank_b"], r["rank_flat"], r["median_rank"], r["place"]) for r in got.collect()} == want


def test_majority_winners(spark):
    rng = random.Random(8)
    data = [(f"g{rng.randrange(40)}", f"i{rng.randrange(9)}", *[rng.choice([None, rng.random()]) for _ in range(3)]) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, i string, x double, y double, z double")
    groups, _ = brute_ranks(data, 3)
    key = lambda v: (v is not None, v if v is not None else 0)
    want = sorted((g, i) for g, items in groups.items() if len(items) >= 3 for i, v in items.items() if all(sum(key(a) > key(b) for a, b in zip(v, o)) >= 2 for j, o in items.items() if j != i))
    r = median_rank.rank_items(df, "g", "i", ["x", "y", "z"])
    assert rows(median_rank.majority_winners(r, "g", "i", ["x", "y", "z"], 3)) == want and want


def test_weighted_median_and_empty(spark):
    df = spark.createDataFrame([("g", "a", 3.0, 1.0), ("g", "b", 2.0, 2.0), ("g", "c", 1.0, 3.0)], "g string, i string, x double, y double")
    heavy = median_rank.rank_items(df, "g", "i", ["x", "y"], weights=[3, 1])
    assert [r["i"] for r in heavy.orderBy("place").collect()] == ["a", "b", "c"]
    assert rows(median_rank.rank_items(df.limit(0), "g", "i", ["x", "y"])) == []


# terms


def tail(k, n, big_k, big_n):
    return sum(comb(big_k, j) * comb(big_n - big_k, n - j) for j in range(k, min(n, big_k) + 1)) / comb(big_n, n)


def test_upper_tail_is_exact():
    rng = random.Random(2)
    cases = [(rng.randint(0, 6), rng.randint(1, 40), rng.randint(1, 60), 120) for _ in range(200)]
    got = distinct_terms.upper_tail(*(np.array(x) for x in zip(*[c[:3] for c in cases])), 120.0)
    for g, (k, n, big_k, big_n) in zip(got, cases):
        want = tail(k, n, big_k, big_n)
        assert (np.exp(g) == pytest.approx(want, rel=1e-9)) if want else np.isneginf(g)


def test_term_scores(spark):
    docs = {"a": ["x", "x", "y"], "b": ["y", "z"], "c": ["y"], "e": [], "long": ["y"] * 3000 + ["z"]}
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] + [("b", ["z", None, ""], 1), (None, ["q"], 1), ("n", None, 1)], "doc string, w array<string>, term int")
    got = {(r["doc"], r["term"]): r for r in distinct_terms.term_scores(df, "doc", "w").collect()}
    n = 3 + 3 + 1 + 3001
    assert set(got) == {("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "y"), ("long", "y"), ("long", "z")}
    assert got["a", "x"]["score"] == pytest.approx(-log(tail(2, 3, 2, n))) and got["b", "z"]["k"] == 2 and got["b", "z"]["df"] == 2
    p = sorted((np.exp(r["ln_p"]), k) for k, r in got.items())
    adj, low = {}, 1.0
    for i in range(len(p) - 1, -1, -1):
        low = min(low, p[i][0] * len(p) / (max(j for j in range(len(p)) if p[j][0] <= p[i][0] * (1 + 1e-12)) + 1))
        adj[p[i][1]] = low
    assert all(got[k]["q"] == pytest.approx(adj[k], rel=1e-6) for k in got)
    assert rows(distinct_terms.term_scores(df.limit(0), "doc", "w")) == []


# set join


def jaccard(a, b):
    return Fraction(len(a & b), len(a | b))


@pytest.mark.parametrize("part", [7, 20_000])
@pytest.mark.parametrize("t", ["0.8", "0.6", "0.5", "0.34", "1"])
def test_set_join(spark, t, part, monkeypatch):
    monkeypatch.setattr(set_join, "FREQUENT", 12)
    monkeypatch.setattr(set_join, "PART", part)  # 7: some keys are dealt into parts
    rng = random.Random(4)
    data = [(f"r{k}", rng.sample([f"w{j}" for j in range(16)], rng.randint(0, 7)) + [None] * rng.randint(0, 1)) for k in range(160)]
    data += [(f"h{k}", ["w0", "w1", f"u{k}"]) for k in range(40)] + [("copy", ["w1", "w0", "w0"]), ("copy2", ["w0", "w1"]), ("none", None), (None, ["w0"])]
    df = spark.createDataFrame([(*r, "x") for r in data], "iri string, e array<string>, class_id string")
    m = set_join.class_table(df, "iri", "e")
    hot = []
    monkeypatch.setattr(set_join, "_hot", lambda *a, f=set_join._hot: hot.append(f(*a)) or hot[-1])
    sets = {i: {x for x in e if x is not None} for i, e in data if i and e and any(x is not None for x in e)}
    want = sorted((a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= Fraction(t))
    pairs = set_join.similar_classes(m, t)
    assert rows(set_join.expand_pairs(m, pairs)) == want and (not hot[0] or part == 7) and (hot[0] or part > 7 or t not in ("0.5", "0.34"))
    links = {r["record"]: r["n_copies"] + r["n_links"] for r in set_join.link_counts(m, pairs).collect()}
    assert links == {i: sum(i in p for p in want) for i in sets}


def test_set_join_empty(spark):
    df = spark.createDataFrame([], "iri string, e array<string>")
    m = set_join.class_table(df, "iri", "e")
    assert rows(set_join.expand_pairs(m, set_join.similar_classes(m, "0.8"))) == []


def test_merges_agree_on_long_lists():
    rng = random.Random(9)
    lists = [sorted(rng.sample(range(300), rng.choice([3, 20, 200]))) for _ in range(9)]
    for t in range(1, 8):
        count = defaultdict(int)
        for x in lists:
            for p in x:
                count[p] += p >= 40
        want = sorted((p, c) for p, c in count.items() if c >= t)
        assert sorted(set_join.merge_skip(lists, 40, t)) == want == sorted(set_join.divide_skip(lists, 40, t))


# splits


def targets(spark, t=(("train", 0.7), ("valid", 0.1), ("test", 0.2))):
    return spark.createDataFrame(list(t), "split_name string, target_share double")


@pytest.mark.parametrize("block", [50, 20_000])
def test_grouped_splits(spark, block):
    rng = random.Random(6)
    data = [(f"e{min(int(rng.expovariate(0.01)), 600)}" if rng.random() > 0.1 else "big", rng.choice([0, 0, 0, 1, None]), rng.choice([0, 1, None])) for _ in range(6000)] + [(None, 1, 0)] * 3
    df = spark.createDataFrame([(*r, "q") for r in data], "src string, label int, fold int, split string")
    out = splits.grouped_splits(df, ["src"], {"n_pos": F.col("label") == 1}, targets(spark), audit="fold", block=block).collect()
    by = defaultdict(set)
    for s, _, f in data:
        by[s] |= {f} - {None}
    assert {r["component"]: r["n_fold"] for r in out} == {s: len(f) for s, f in by.items() if s is not None}
    total = sum(r["n_rows"] for r in out)
    assert total == 6000
    for name, share in (("train", 0.7), ("valid", 0.1), ("test", 0.2)):
        for c, n in (("n_rows", total), ("n_pos", sum(r["n_pos"] for r in out))):
            assert sum(r[c] for r in out if r["split"] == name) / n == pytest.approx(share, abs=0.02)


def test_splits_join_several_keys(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "z"), (None, "z"), (None, None)], "k1 string, k2 string")
    out = splits.grouped_splits(df, ["k1", "k2"], {}, targets(spark)).collect()
    assert sorted(r["n_rows"] for r in out) == [2, 3]


@pytest.mark.parametrize("run", [7, 10_000])
def test_splits_hold_rows_without_a_key(spark, monkeypatch, run):
    """A third of the rows has no key; equal ones count too, and are spread over the splits."""
    monkeypatch.setattr(splits, "RUN", run, raising=False)
    data = [(f"e{k % 1000}", k % 4 == 0, k) for k in range(2000)] + [(None, k % 2 == 0, k) for k in range(400)] + [(None, True, None)] * 600
    df = spark.createDataFrame(data, "k string, pos boolean, x int")
    out = splits.grouped_splits(df, ["k"], {"n_pos": F.col("pos")}, targets(spark), alone=True).collect()
    assert sum(r["n_rows"] for r in out) == 3000 and sum(r["n_pos"] for r in out) == 500 + 200 + 600
    assert sum(r["alone"] for r in out) == 1000 and len({(r["component"], r["alone"]) for r in out}) == len(out) == 2000
    for name, share in (("train", 0.7), ("valid", 0.1), ("test", 0.2)):
        for c, n in (("n_rows", 3000), ("n_pos", 1300)):
            assert sum(r[c] for r in out if r["split"] == name) / n == pytest.approx(share, abs=0.02)


def test_split_queries_hold_all_rows(spark, data):  # the smallest tables have no row without a source
    data = data.replace("sf0.001", "sf0.01")
    n = sum(spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("train", "oof_scores"))
    for q in ("p4_splits", "p4_shares"):
        assert sum(r["n_rows"] for r in queries()[q](spark, data).collect()) == n


def test_splits_edges(spark):
    none = spark.createDataFrame([], "k string")
    assert splits.grouped_splits(none, ["k"], {}, targets(spark)).count() == 0
    one = spark.createDataFrame([("a",)], "k string")
    assert splits.grouped_splits(one, ["k"], {}, targets(spark, [("t", 0.0), ("u", None)])).first()["split"] is None


# identifiers and tokens


def test_canonical_iri(spark):
    want = "http://avelon.example/ont#AV_001"
    given = [want, "AV:001", "https://avelon.example/ont#AV_001", "<http://avelon.example/ont#AV_001>", "\thttp://AVELON.example/ont#AV_001\n", "http://www.avelon.example/ont%23AV_001", want + " "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], "x string").select(canonical_iri(F.col("x"))).collect()]
    assert got == [want] * len(given)
    odd = spark.createDataFrame([("MBL:7",), ("",), ("  ",), (None,), ("other",)], "x string").select(canonical_iri(F.col("x"))).collect()
    assert [r[0] for r in odd] == ["http://morbex.example/legacy#MB_7", None, None, None, "other"]


def test_token_count_is_python_words(spark):
    import re

    texts = ["", None, "a b", "don't stop...", "été x_1 ½²", "日本 語。", "  tab\x1c\x85end", "price: 3,50€ (ca.)", "x" * 5000, " \n "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts] and PATTERN
