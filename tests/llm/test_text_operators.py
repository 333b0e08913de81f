"""Packing, mixing, reading levels and entity matching: their guarantees and edge cases."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import entity_match, mixing, packing, reading_level

# packing


@pytest.mark.parametrize("block", [60, 2000])
def test_pack(spark, block):
    rng = random.Random(1)
    sizes = {k: rng.choice([0, 1, 99, 100, 101, 200, 257]) if rng.random() < 0.2 else rng.randint(1, 60) for k in range(400)}
    df = spark.createDataFrame([(k, v, "c") for k, v in sizes.items()] + [(900, None, "c"), (None, 5, "c"), (3, sizes[3], "c")], "doc_id bigint, size int, container string")
    out = packing.pack(df, "doc_id", "size", 100, block=block)
    got = out.collect()
    fill, parts = defaultdict(int), defaultdict(list)
    for r in got:
        if r["container"] is not None:
            fill[r["container"]] += r["size"]
        parts[r["doc_id"]].append(r)
    assert max(fill.values()) <= 100 and set(parts) == set(sizes) | {900}
    for k, n in sizes.items():
        p = sorted(parts[k], key=lambda r: r["start"] or 0)
        copies = 2 if k == 3 else 1
        assert sum(r["size"] for r in p) == n * copies and p[0]["pieces"] == -(-n // 100)
        if n <= 100:
            assert len(p) == copies
        assert (p[0]["container"] is None) == (n == 0)
    total = sum(sizes.values()) + sizes[3]
    assert len(fill) <= 1.06 * -(-total // 100) + 1
    assert sorted(map(str, out.collect())) == sorted(map(str, packing.pack(df, "doc_id", "size", 100, block=block).collect()))


def test_pack_edges(spark):
    empty = spark.createDataFrame([], "d string, n int")
    assert packing.pack(empty, "d", "n", 10).count() == 0
    blank = spark.createDataFrame([("a", 0), ("b", None)], "d string, n int")
    assert {r["container"] for r in packing.pack(blank, "d", "n", 10).collect()} == {None}
    with pytest.raises(ValueError):
        packing.pack(blank, "d", "n", 0)


def test_evolution_beats_best_fit():
    """Triplets that fill containers exactly mislead best fit; crossover of well-filled bins recovers some."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        sizes = []
        for _ in range(40):
            a = int(rng.integers(380, 499))
            b = int(rng.integers(250, (1000 - a) // 2 + 1))
            sizes += [a, b, 1000 - a - b]
        plain = packing._best_fit([], sorted(range(120), key=lambda i: -sizes[i]), sizes, 1000)
        best = packing.evolve(sizes, 1000, 1)[0]
        assert sorted(i for b in best for i in b) == list(range(120)) and max(sum(sizes[i] for i in b) for b in best) <= 1000
        assert len(best) < len(plain)


def test_pack_ends_where_packing_again_saves_nothing(spark):
    """Items of 60 fill every container badly, in any number of blocks."""
    df = spark.createDataFrame([(k, 60) for k in range(500)], "id int, n int")
    out = packing.pack(df, "id", "n", 100, block=40).collect()
    assert len({r["container"] for r in out}) == 500


def test_evolution_never_worsens():
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 70, 300).tolist()
    first = packing._best_fit([], sorted(range(300), key=lambda i: -sizes[i]), sizes, 100)
    best = packing.evolve(sizes, 100, 1)[0]
    assert sorted(i for b in best for i in b) == list(range(300)) and max(sum(sizes[i] for i in b) for b in best) <= 100
    assert packing._fitness(best, sizes, 100) >= packing._fitness(first, sizes, 100)


# mixing


def mix_targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("block", [100, 20_000])
def test_mix(spark, block):
    rng = random.Random(2)
    docs = [(k, rng.choice(["Big One", "big_one", "BIG-ONE", "small", "tiny", None, "other"]), rng.randint(1, 400), "s") for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, size int, copies string")
    t = mix_targets(spark, [("big_one", 0.3, 2), ("small", 0.2, 3), ("tiny", 0.6, 2), ("gone", 0.05, 1)])
    drawn, report = mixing.mix(df, "doc_id", "source", "size", t, block=block)
    total = sum(d[2] for d in docs)
    rep = {r["source"]: r for r in report.collect()}
    for s in ("big_one", "small"):
        assert rep[s]["drawn_size"] == pytest.approx(rep[s]["target"], rel=0.01) and not rep[s]["short"]
        assert abs(rep[s]["drawn_records"] - rep[s]["rate"] * rep[s]["n_records"]) <= 2
    assert rep["tiny"]["short"] and rep["tiny"]["drawn_size"] == rep["tiny"]["capacity"]
    assert rep["gone"]["short"] and rep["gone"]["drawn_records"] == 0 and rep["big_one"]["target"] == pytest.approx(0.3 * total)
    got = drawn.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["copies"] <= {"big_one": 2, "small": 3, "tiny": 2}[r["source"]] for r in got)
    assert sum(r["copies"] * r["size"] for r in got if r["source"] == "small") == rep["small"]["drawn_size"]


def test_mix_empty(spark):
    df = spark.createDataFrame([], "d bigint, source string, n int")
    drawn, report = mixing.mix(df, "d", "source", "n", mix_targets(spark, [("a", 0.5, 1)]))
    assert drawn.count() == 0 and report.first()["drawn_size"] == 0
    some = spark.createDataFrame([(1, "a", 0), (2, None, None)], "d bigint, source string, n int")
    assert mixing.mix(some, "d", "source", "n", mix_targets(spark, [("a", 0.5, 1)]))[0].count() == 0


def test_flight_keeps_totals_and_expectations():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 500).astype(float).tolist()
    p = mixing.flight([0.3] * 500, sizes, rng)
    assert sum(0 < x < 1 for x in p) <= 2 and sum(p) == pytest.approx(150) and sum(a * b for a, b in zip(p, sizes)) == pytest.approx(0.3 * sum(sizes))
    q = mixing.land(p, rng)
    assert set(q) <= {0.0, 1.0} and abs(sum(q) - 150) <= 1
    draws = np.mean([mixing.land(mixing.flight([0.4] * 7, [5.0, 5, 5, 9, 1, 2, 3], np.random.default_rng(k)), np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(draws - 0.4).max() < 0.05


# reading level


def test_reading_levels_on_held_out_grades(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/reading_labels.parquet").filter("grade_band IS NOT NULL")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = reading_level.reading_levels(docs.withColumn("level", F.lit("x")), "doc_id", "text", labels.filter(~held), "doc_id", "grade_band")
    truth = labels.filter(held).groupBy("doc_id").agg(F.avg("grade_band").alias("g"), F.count_distinct("grade_band").alias("d")).filter("d = 1")
    got = truth.join(out, "doc_id").filter("band IS NOT NULL").toPandas()
    assert len(got) >= 10 and (got["g"] == got["band"]).mean() >= 0.75
    assert out.count() == docs.count()


def test_reading_levels_edges(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "..."), (4, "The cat sat. " * 4000), (5, "Notwithstanding heterogeneity, gliosis supervenes.")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, grade_band int")
    out = {r["doc_id"]: r for r in reading_level.reading_levels(docs, "doc_id", "text", none, "doc_id", "grade_band").collect()}
    assert all(r["band"] is None for r in out.values()) and out[4]["n_words"] == 12000 and out[1]["n_words"] in (None, 0)
    some = spark.createDataFrame([(4, 1), (4, 1), (5, 3), (2, 3), (99, 2), (1, None)], "doc_id bigint, grade_band int")
    out = {r["doc_id"]: r["band"] for r in reading_level.reading_levels(docs, "doc_id", "text", some, "doc_id", "grade_band").collect()}
    assert out[4] == 1 and out[5] == 3 and out[1] is None and out[2] is None and out[3] is None
    assert reading_level.reading_levels(docs.limit(0), "doc_id", "text", some, "doc_id", "grade_band").count() == 0


def test_layout_does_not_move_measures():
    plain = "You can rest. It will get better in two weeks. Tell the doctor if it hurts."
    dressed = "Page 3 of 7\n### Card\n<div><p>YOU CAN REST.</p>\n* It will get better\nin two weeks.\n- Tell the doctor if it hurts. (cf. Fig. 2, p. 14)</div>"
    parsed = [reading_level.parse(x) for x in (plain, dressed)]
    (a, b), _ = reading_level.Lexicon({}, {}).measures([w for w, _ in parsed], np.array([m for _, m in parsed], dtype=float))
    k = reading_level.MEASURES.index("pronouns")
    assert a[k] == pytest.approx(b[k], abs=0.08)
    assert reading_level.words_of(reading_level.clean("mál")) == reading_level.words_of("mál") == ["mal"]
    assert reading_level.clean("cafÃ©") == "café"


def test_ordinal_model_orders_bands():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = np.digitize(x[:, 0] + 0.2 * rng.normal(size=300), [-0.5, 0.5])
    m = reading_level.fit_ordinal(x, y, np.ones(300), 3)
    assert (m.probabilities(x).argmax(axis=1) == y).mean() > 0.85 and np.allclose(m.probabilities(x).sum(axis=1), 1) and (np.diff(m.cuts) > 0).all()


# entity matching


def profile_rows(n=150):
    """Families of invented names; every class has names built from interchangeable words, and a close relative."""
    rng = random.Random(11)
    kinds, organs, mods = [("ulcer", "ulceration"), ("cyst", "cavity"), ("edema", "swelling")], [("ear", "aural"), ("eye", "ocular"), ("skin", "cutaneous"), ("heart", "cardiac")], [("left", "sinistral"), ("right", "dextral"), ("chronic", "longstanding"), ("acute", "sudden")]
    syl = ["ba", "ku", "zo", "ri", "ne", "fa", "du", "mi", "lo", "ge"]
    rows, truth = [], []
    for k in range(n):
        name = "".join(rng.choice(syl) for _ in range(5)) + "xyz"[k % 3]
        kind, organ = rng.choice(kinds), rng.choice(organs)
        for j, mod in enumerate(rng.sample(mods, 2)):
            for side in (0, 1):
                names = [f"{name} {rng.choice(kind)} of {rng.choice(organ)} {rng.choice(mod)}" for _ in range(6)]
                rows.append((f"{'st'[side]}{k}-{j}", side, names[0].title() if rng.random() > 0.1 else None, names[1:] + ["disorder nos", None]))
            truth.append((f"s{k}-{j}", f"t{k}-{j}"))
    return rows, set(truth)


def test_match_finds_the_same_classes(spark):
    rows, truth = profile_rows()
    df = spark.createDataFrame(rows + rows[:5], "iri string, side int, label string, labels array<string>")
    ents = entity_match.entities(df, "iri", F.col("side"), F.concat(F.array("label"), "labels"))
    m = entity_match.match(ents)
    got = {tuple(sorted((r["a"], r["b"]))) for r in m.filter("posterior >= 0.5 AND sa <> sb").collect()}
    hits = len(got & truth)
    assert hits / len(truth) > 0.9 and hits / len(got) > 0.9


def matched(spark, rows):
    df = spark.createDataFrame(rows, "iri string, side int, t array<string>")
    return {tuple(sorted((r["a"], r["b"]))) for r in entity_match.match(entity_match.entities(df, "iri", F.col("side"), F.col("t"))).filter("posterior >= 0.5 AND sa <> sb").collect()}


def test_match_of_short_and_numbered_words(spark):
    """Classes named by short words or codes only."""
    rows, truth = profile_rows()
    tail = ["left", "right", "chronic", "acute"]
    rows = [(i, s, [x for x in [a, *b] if x]) for i, s, a, b in rows]
    for k in range(40):
        name, mod = (f"q{chr(97 + k % 26)}{k}", f"z{chr(97 + k % 26)}{chr(97 + k // 26)}")[k % 2], tail[k % 4]
        for side in (0, 1):
            rows.append((f"{'st'[side]}c{k}", side, [f"{name} {mod} ulcer", f"ulcer {mod} of {name}", f"{name} ulceration, {mod}"]))
        truth.add((f"sc{k}", f"tc{k}"))
    got = matched(spark, rows)
    codes = {p for p in truth if p[0].startswith("sc")}
    assert codes <= got and len(got & truth) / len(got) > 0.9


def test_match_of_a_class_with_very_many_identifiers(spark, monkeypatch):
    """Its name is as frequent as an everyday word, and parts of a key are compared with each other."""
    monkeypatch.setattr(entity_match, "PART", 25, raising=False)
    rows, truth = profile_rows()
    rows = [(i, s, [x for x in [a, *b] if x]) for i, s, a, b in rows]
    for k in range(40):
        for side in (0, 1):
            rows.append((f"{'st'[side]}m{k:02d}", side, ["morgelune ulcer of skin left", "left cutaneous morgelune ulcer", "morgelune ulceration skin sinistral", f"mrogel{'abcdefghij'[k % 10]}{'klmno'[k // 10]}{'uv'[side]} ulcer"][: 3 + k % 2]))
    many = {(f"sm{a:02d}", f"tm{b:02d}") for a in range(40) for b in range(40)}
    got = matched(spark, rows)
    assert many <= got and len(got & (truth | many)) / len(got) > 0.9 and len(got & truth) / len(truth) > 0.9


def test_match_under_crowded_words(spark, monkeypatch):
    """A rare word of more entities than are compared with each other only brings together those of like meanings; nothing else is lost."""
    rows, truth = profile_rows()
    rows = [(i, s, [x for x in [a, *b] if x]) for i, s, a, b in rows]
    every = matched(spark, rows)
    monkeypatch.setattr(entity_match, "CEILING", 3)
    monkeypatch.setattr(entity_match, "PART", 2)
    got = matched(spark, rows)
    assert len(got & truth) / len(truth) > 0.9 and len(got & truth) / len(got) > 0.9 and len(got ^ every) <= 0.02 * len(every)


def test_pairs_do_not_depend_on_how_many_have_a_word(spark, monkeypatch):
    """All entities of a rare word are compared, in one group or in parts, those of unlike meanings or of none too; each pair once."""
    rows, _ = profile_rows()
    rows = [(i, s, [x for x in [a, *b] if x]) for i, s, a, b in rows]
    usual = sorted({w for _, _, t in rows[:40] for x in t for w in x.lower().split()[1:]})
    for k in range(30):  # the last three have no other word
        names = [f"vornelith {usual[k % len(usual)]} {usual[(7 * k + 3) % len(usual)]}", f"vornelith {usual[k % len(usual)]}"] if k < 27 else ["vornelith"]
        rows.append((f"{'st'[k % 2]}v{k:02d}", k % 2, [*names, f"{usual[k % len(usual)]} b{k % 5}"] if k < 27 else names))
    ents = entity_match.entities(spark.createDataFrame(rows, "iri string, side int, t array<string>"), "iri", F.col("side"), F.col("t"))
    every = sorted(tuple(r) for r in entity_match.match(ents).collect())
    named = {f"{'st'[k % 2]}v{k:02d}" for k in range(30)}
    assert {r[:2] for r in every if set(r[:2]) <= named} == set(combinations(sorted(named), 2))
    monkeypatch.setattr(entity_match, "CEILING", 3)
    monkeypatch.setattr(entity_match, "PART", 2)
    assert sorted(tuple(r) for r in entity_match.match(ents).collect()) == every


def test_posterior_as_expression(spark):
    m = entity_match.Mixture(0.3, np.array([[0.2, 0.1, 0.0], [0.9, 0.8, 0.7]]), np.array([np.eye(3) * 0.05, np.eye(3) * 0.02 + 0.005]))
    x = np.random.default_rng(1).random((50, 3))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, x0 double, x1 double, x2 double")
    assert np.allclose([r[0] for r in df.orderBy("k").select(m.column()).collect()], m.posterior(x))


def test_plain_keys_meet():
    """Every two sets with more than half of their union in common share a key, and the first common pair is one of both."""
    v = entity_match.Vocabulary({w: k for k, w in enumerate("abcdefg")}, Counter())
    sets = [frozenset(c) for n in range(1, 6) for c in combinations("abcdefg", n)]
    for x, y in combinations(sets, 2):
        if 2 * len(x & y) > len(x | y):
            assert " ".join(v.ordered(x & y)[:2]) in set(v.keys(dict.fromkeys(x, 1.0))) & set(v.keys(dict.fromkeys(y, 1.0)))


def test_match_edges(spark):
    schema = "iri string, side int, t array<string>"
    empty = entity_match.entities(spark.createDataFrame([], schema), "iri", F.col("side"), F.col("t"))
    assert entity_match.match(empty).count() == 0
    odd = spark.createDataFrame([("a", 0, None), ("b", 1, []), (None, 1, ["x"]), ("c", 0, [None, "", "QC:12", "2020-01-01"]), ("d", 1, ["zorglub " * 3000]), ("e", 0, ["zorglub thing"])], schema)
    out = entity_match.match(entity_match.entities(odd, "iri", F.col("side"), F.col("t")))
    assert {(r["a"], r["b"]) for r in out.collect()} <= {("d", "e")}


def test_mixture_separates():
    rng = np.random.default_rng(3)
    low, high = rng.normal(0.2, 0.05, (400, 3)), rng.normal(0.9, 0.03, (60, 3))
    x = np.vstack([low, high])
    g = (x.mean(axis=1) > 0.75).astype(float)
    for _ in range(20):
        n = np.array([(1 - g).sum(), g.sum()])
        s = np.array([(1 - g) @ x, g @ x])
        ss = np.array([(x * (1 - g)[:, None]).T @ x, (x * g[:, None]).T @ x])
        m = entity_match.Mixture.from_sums(n, s, ss)
        g = m.posterior(x)
    assert (g[:400] < 0.5).all() and (g[400:] > 0.5).all() and m.posterior(np.ones((1, 3)))[0] > 0.9


def test_transitivity_caps(spark):
    pairs = [("a", "b", 0.95), ("b", "c", 0.9), ("a", "c", 0.2), ("d", "e", 0.9)]
    caps = {(r["a"], r["b"]): r["limit"] for r in entity_match._caps(spark.createDataFrame(pairs, "a string, b string, g double")).collect()}
    assert set(caps) == {("b", "c")} and caps["b", "c"] == pytest.approx(0.2 / 0.95)


