"""Operators whose results SQL can't state, and their contracts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import dense, entity, evaluation, gnn, learn, matching, ontology, pairs, ranking, retrieval
from brindle.operators.skew import hot_keys, salted_join
from brindle.plans import config, pipeline, registry
from brindle.plans.features import FeaturePipeline, base_features, deep_features, meta_features, normalized_profiles
from brindle.sources import mappings, rdf
from brindle.sources.materialize import reuse_or_write, write_table
from brindle.streaming import scoring


def graph(rng, n=60, k=12):
    return [(f"s{rng.randrange(k)}", f"t{rng.randrange(k)}", rng.choice([0.1, 0.5, 0.5, 0.9, round(rng.random(), 2)])) for _ in range(n)]


def sequential(rows):
    s, t, out = set(), set(), set()
    for a, b, x in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in s and b not in t:
            s.add(a)
            t.add(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("rounds", [20, 1])
def test_greedy_equals_the_sequential_pass(spark, rounds):
    for seed in range(4):
        rows = list({r[:2]: r for r in graph(random.Random(seed))}.values())
        df = spark.createDataFrame(rows, "src_iri string, tgt_iri string, score double")
        got = {(r[0], r[1]) for r in matching.greedy(df, max_rounds=rounds).collect()}
        assert got == sequential(rows)
        assert {(r[0], r[1]) for r in matching.select_matches(df, 0.5, "greedy_1to1").collect()} == {p for p in got if {r[:2]: r[2] for r in rows}[p] >= 0.5}


def test_alternating_chain(spark):
    rows = [(f"s{k // 2:02d}", f"t{(k + 1) // 2:02d}", k / 100) for k in range(60)]
    df = spark.createDataFrame(rows, "src_iri string, tgt_iri string, score double")
    assert {(r[0], r[1]) for r in matching.greedy(df, max_rounds=3).collect()} == sequential(rows)


def test_modes_and_recovery(spark):
    rows = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.3), ("c", "z", 0.4), ("c", "x", 0.1)]
    df = spark.createDataFrame(rows, "src_iri string, tgt_iri string, score double")
    pick = lambda m, t=0.0, **k: {(r[0], r[1]) for r in matching.select_matches(df, t, m, **k).collect()}
    assert pick("top1_src") == {("a", "x"), ("b", "x"), ("c", "z")} and pick("mutual_best") == {("a", "x"), ("c", "z")}
    assert pick("greedy_1to1") == pick("mutual_then_greedy") == {("a", "x"), ("b", "y"), ("c", "z")}
    assert pick("none", 0.8, rank_src_max=1) == {("a", "x"), ("b", "x")}
    assert {(r["src_iri"], r["stage"]) for r in matching.recovery(df, 0.8, 0.35, 0.1, 1).collect()} == {("a", "core"), ("c", "rescue")}
    with pytest.raises(ValueError):
        matching.select_matches(df, 0.0, "best")


def test_salted_join(spark):
    big = spark.createDataFrame([("hot", k) for k in range(300)] + [(f"k{k}", k) for k in range(50)] + [(None, 1)], "k string, v int")
    small = spark.createDataFrame([("hot", "H"), ("k3", "x"), ("k4", "y")], "k string, w string")
    hot = hot_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", share=4, least=20)
    assert [tuple(r) for r in hot.collect()] == [("hot", 4)]
    for how, n in (("inner", 302), ("left", 351), ("left_anti", 49), ("left_semi", 302)):
        assert salted_join(big, small, "k", hot, F.col("v"), how).count() == n


def test_written_tables(spark, tmp_path):
    w = write_table(spark.range(3).withColumn("x", F.lit("é")))
    assert w.df.count() == 3
    w.drop()
    url, calls = f"file://{tmp_path}/stage", []
    build = lambda: calls.append(1) or spark.range(2)
    assert reuse_or_write(spark, url, build).count() == reuse_or_write(spark, url, build).count() == 2 and len(calls) == 1


OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:skos="http://www.w3.org/2004/02/skos/core#" xmlns:obo="http://purl.example/obo/" xml:base="http://ex.org/o">
<owl:Class rdf:about="#A0"><rdfs:label>Root thing</rdfs:label></owl:Class>
<owl:Class rdf:about="#A1"><rdfs:label xml:lang="en">Heart disease</rdfs:label><skos:altLabel>Cardiac disease</skos:altLabel><skos:altLabel>Cardiac disease</skos:altLabel><obo:IAO_0000115>A disease of the heart.</obo:IAO_0000115><rdfs:subClassOf rdf:resource="#A0"/></owl:Class>
<owl:Class rdf:about="#A2"><rdfs:subClassOf rdf:resource="#A1"/><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#p"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="#HeartValve_x"><rdfs:subClassOf rdf:resource="#A1"/></owl:Class>
<owl:Class rdf:about="#B2"><rdfs:subClassOf rdf:resource="#A0"/></owl:Class>
<owl:Class rdf:about="#B3"><rdfs:subClassOf rdf:resource="#B2"/></owl:Class>
<owl:Class rdf:about="#C1"><rdfs:subClassOf rdf:resource="#C2"/></owl:Class>
<owl:Class rdf:about="#C2"><rdfs:subClassOf rdf:resource="#C1"/></owl:Class>
<owl:ObjectProperty rdf:about="#p"/>
</rdf:RDF>"""


@pytest.fixture(scope="module")
def onto(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("owl")
    (folder / "alpha.owl").write_text(OWL)
    (folder / "beta.owl").write_text(OWL.replace("Heart disease", "Disease of heart"))
    assert [p.rsplit("/", 1)[1] for p in rdf.ontology_files(str(folder), "Beta-Alpha")] == ["beta.owl", "alpha.owl"]
    triples = rdf.read_triples(spark, str(folder / "alpha.owl")).cache()
    ents = ontology.labels(ontology.entities(triples), triples).cache()
    return triples, ents, ontology.hierarchy(triples, ents).cache()


def short(rows):
    return sorted(tuple(str(x).rsplit("#", 1)[-1] for x in r) for r in rows)


def test_ontology(spark, onto):
    triples, ents, edges = onto
    by = {r["iri"].rsplit("#", 1)[1]: r for r in ents.collect()}
    assert set(by) == {"A0", "A1", "A2", "B2", "B3", "C1", "C2", "HeartValve_x"}
    assert by["A1"]["label"] == "Heart disease" and by["A1"]["synonyms"] == ["Cardiac disease"] and by["HeartValve_x"]["label"] == "Heart Valve x"
    assert ontology.entities(triples, "classes_and_properties").filter("entity_type = 'property'").count() == 1
    assert len(edges.collect()) == 7
    up = short(ontology.layers(edges, "up").collect())
    assert ("A2", "A1", "1") in up and ("A2", "A0", "2") in up and ("C1", "C2", "1") in up and not any(a == b for a, b, _ in up)
    assert ("A2", "HeartValve_x") in short(ontology.siblings(edges).collect()) and ("A2", "B3") in short(ontology.cousins(edges).collect())
    rel = short(ontology.relations(edges).select("relation", "iri", "node").collect())
    assert ("neighbors_any", "A2", "B3") in rel and ("descendants_any", "A0", "B3") in rel and ("descendant_d2", "A0", "B3") in rel
    notes = ontology.annotations(triples, ents)
    assert {(r["tag"], r["role"]) for r in notes.collect()} == {("label", "label"), ("altlabel", "synonym"), ("iao_0000115", "definition")}
    text = {r["iri"].rsplit("#", 1)[1]: r["text"] for r in ontology.concept_texts(ents, edges, notes).collect()}
    assert text["A1"] == "Label: Heart disease [SEP] Definition: A disease of the heart. [SEP] Synonyms: Cardiac disease [SEP] Parents: Root thing [SEP] Children: A2; Heart Valve x"
    assert ontology.by_property_end(triples, ontology.DEFINITION_ENDS).first()["vals"] == ["A disease of the heart."]
    assert ontology.with_counts(ents, edges).filter("label = 'Heart disease'").select("n_parents", "n_children", "n_synonyms").first() == (1, 2, 1)
    assert ontology.lookup(ents, ents.limit(2)).count() == 2 and ontology.tag_inventory(triples).count() > 3


def test_features_keep_the_contract(spark, onto):
    triples, ents, edges = onto
    prof = normalized_profiles(ents, edges, ontology.annotations(triples, ents)).cache()
    rel = ontology.relations(edges).cache()
    iri = [r["iri"] for r in ents.orderBy("iri").collect()]
    p = spark.createDataFrame([(a, b) for a in iri[:4] for b in iri[:4]], "src_iri string, tgt_iri string")
    gold = spark.createDataFrame([(x, x) for x in iri], "src_iri string, tgt_iri string")
    deep = deep_features(p, prof, prof, rel, rel, gold)
    assert deep.columns[2:] == registry.DEEP and len(registry.DEEP) == 313
    a1 = next(r for r in deep.collect() if r["src_iri"].endswith("#A1") and r["tgt_iri"].endswith("#A1"))
    assert a1["label_exact_normalized"] == a1["label_sequence_ratio"] == a1["all_labels_value_jaccard"] == a1["role_definition_token_dice"] == 1.0
    assert a1["train_support_descendant_d1"] == 2.0 and a1["train_support_cross_ancestor_d1_d1"] == 1.0 and a1["ancestor_d1_count_src"] == 1.0
    enc = dense.HashingEncoder(16).encode(ents, "iri", "label")
    full = p.join(enc.select(F.col("iri").alias("src_iri"), F.col("vec").alias("src_vec"), F.col("cloud").alias("src_cloud")), "src_iri").join(enc.select(F.col("iri").alias("tgt_iri"), F.col("vec").alias("tgt_vec"), F.col("cloud").alias("tgt_cloud")), "tgt_iri").withColumn("src_label", F.lit("heart disease")).withColumn("tgt_label", F.lit("disease of heart"))
    full = full.cache()
    base = base_features(full)
    assert base.columns[2:] == registry.BASE and base.count() == 16
    union = pairs.union_provenance(p, p.limit(3).withColumn("graph06_score", F.lit(0.5)))
    meta = meta_features(full, union, union)
    assert meta.columns[2:] == registry.META and not meta.filter("graph06_cdf < 0 OR graph06_cdf > 1").count()
    everything = pairs.assemble(p, {"meta": meta, "deep": deep}, 403)
    assert everything.columns[2:] == registry.ALL
    sizes = {k: len(v) for k, v in registry.spaces().items()}
    assert sizes == registry.FAMILY_SIZES | {"global": 403}
    with pytest.raises(ValueError):
        FeaturePipeline(("syntax", "nothing"))


def test_mappings(spark, tmp_path):
    f = tmp_path / "m.tsv"
    f.write_text("SrcEntity\tTgtEntity\tScore\na\tx\t1.0\na\tx\t0.5\n\ty\t1\nb\ty\tbad\n")
    assert sorted(map(tuple, mappings.read_mappings(spark, str(f)).collect())) == [("a", "x", 1.0), ("b", "y", None)]
    g = tmp_path / "c.tsv"
    g.write_text("SrcEntity\tTgtEntity\tTgtCandidates\na\tx\t('x', 'y', \"z\")\nb\ty\t\n")
    assert [(r["tgt_candidates"], r["n_candidates"]) for r in mappings.read_candidates(spark, str(g)).orderBy("SrcEntity").collect()] == [(["x", "y", "z"], 3), ([], 0)]
    with pytest.raises(ValueError):
        mappings.rename_columns(spark.createDataFrame([(1,)], "foo int"))
    sub = pairs.submission(spark.createDataFrame([("a", "x"), ("b", "y")], "src_iri string, tgt_iri string"))
    out = tmp_path / "sub"
    mappings.write_tsv(sub, f"file://{out}")
    names = mappings.package({"one/sub.tsv": str(out)}, str(tmp_path / "p.zip"))
    assert names == ["one/sub.tsv"] and mappings.zip_header(str(tmp_path / "p.zip"), "one/sub.tsv") == ["SrcEntity\tTgtEntity\tRelation"]
    import zipfile

    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("d.csv", "a,b,c\n1,2,3\n")
    assert mappings.read_zip_csv(spark, str(tmp_path / "q.zip"), "d.csv", ["a", "c"]).first() == ("1", "3")
    assert pairs.validate_submission(sub.unionByName(sub.limit(1))).first()["valid"] is False
    mappings.write_json({"a": 1}, str(tmp_path / "r.json"))


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(30, 6)), np.vstack([rng.normal(size=(70, 6)), np.zeros((1, 6))])
    df = lambda x, p: spark.createDataFrame([(f"{p}{k:03d}", v.tolist()) for k, v in enumerate(x)], "iri string, vec array<double>")
    for metric in ("cosine", "l2"):
        got = {(r["src_iri"], r["rank"]): r["tgt_iri"] for r in dense.nearest(df(q, "q"), df(c, "c"), 3, metric, block=16).collect()}
        s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]).T if metric == "cosine" else -np.linalg.norm(q[:, None] - c[None], axis=2)
        want = {(f"q{i:03d}", r + 1): f"c{j:03d}" for i in range(30) for r, j in enumerate(np.argsort(-s[i], kind="stable")[:3])}
        assert got == want


def test_graph_encoder(spark):
    w = gnn.GraphWeights.random(4, 3)
    x = np.random.default_rng(5).normal(size=(4, 4))
    nodes = spark.createDataFrame([(f"n{i}", x[i].tolist()) for i in range(4)], "iri string, vec array<double>")
    links = [(0, 1), (1, 0), (1, 2), (2, 1)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links], "x string, y string")
    got = {r["iri"]: r["vec"] for r in gnn.message_layer(nodes, edges, w).collect()}
    for i in range(4):
        from_ = [a for a, b in links if b == i]
        m = np.zeros(4)
        if from_:
            a = np.array([(x[i] @ w.q) @ (x[j] @ w.k) / np.sqrt(3) for j in from_])
            a = np.exp(a - a.max())
            m = (a / a.sum()) @ np.array([x[j] @ w.v for j in from_])
        assert np.allclose(got[f"n{i}"], np.maximum((m + x[i]) @ w.w1, 0) @ w.w2)
    enc = gnn.encode_graph(nodes, edges, w)
    assert np.allclose([np.linalg.norm(r["vec"]) for r in enc.collect()], 1)
    gold = spark.createDataFrame([("n0", "n1"), ("n2", "n3")], "src_iri string, tgt_iri string")
    tp = gnn.training_pairs(gold, nodes, 3)
    assert tp.filter("label = 1").count() == 2 and tp.join(gold, ["src_iri", "tgt_iri"]).filter("label = 0").count() == 0
    _, losses = gnn.fit_gate(enc, nodes, tp, w, epochs=5)
    assert losses[-1] <= losses[0]


def test_negatives_are_whole(spark):
    """Hardly a draw is lost, and nearly every target is drawn (2000 draws of 500 leave out 1.8 %)."""
    targets = spark.createDataFrame([(f"t{i}",) for i in range(500)], "iri string")
    gold = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(200)], "src_iri string, tgt_iri string")
    neg = gnn.training_pairs(gold, targets, 10).filter("label = 0").toPandas()
    assert len(neg) / 200 > 9.7 and neg["tgt_iri"].nunique() > 480


def test_entity_statistics_edges(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.1), ("b", 0.0), ("c", None), ("c", float("nan"))], "e string, score double")
    r = {x["entity"]: x for x in entity.entity_statistics(df, "e").collect()}
    assert set(r) == {"a", "b", "c"} and r["c"]["feat__max"] == 0.0 and r["c"]["feat__hhi"] == pytest.approx(0.5) and len([c for c in r["a"].asDict() if c.startswith("feat__")]) == 54
    assert r["a"]["feat__gap12"] == pytest.approx(0.8) and r["b"]["feat__effective_n"] == pytest.approx(1.0)
    cf = entity.counterfactuals(df.withColumn("label", (F.col("score") > 0.5).cast("int")), "e", "score", "label")
    assert sorted(cf.select("entity", "label", "sample_weight").collect()) == [("a", 0, 0.25), ("c", 0, 0.25)]  # NaN is above any number


def test_gates(spark):
    df = spark.createDataFrame([(0.2, 0.9)], "src_conf double, tgt_conf double")
    assert [k for k in entity.GATES if df.filter(entity.gate(k, 0.5)).count()] == ["none", "tgt_only", "low_low_veto"]
    assert df.filter(entity.gate("geomean_rank", 0.42)).count() == 1


def test_percent_ranks_like_averages(spark):
    rng = random.Random(1)
    v = [rng.randrange(20) for _ in range(120)]
    got = ranking.pct_ranks(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, x double"), ["i"], ["x"]).orderBy("i").collect()
    want = [(sum(y < x for y in v) + 1 + (sum(y == x for y in v) - 1) / 2) / len(v) for x in v]
    assert np.allclose([r["rank__x"] for r in got], want)


def test_learning(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{k % 40}", k, float(x), float(rng.normal()), int(x + 0.3 * rng.normal() > 0.6)) for k, x in enumerate(rng.normal(size=240))]
    df = spark.createDataFrame(rows, "src_iri string, k int, x double, y double, label int").withColumn("fold", learn.group_fold("src_iri", 2)).cache()
    oof = learn.out_of_fold(df, "logistic", ["x", "y"], "fold", 2).cache()
    assert oof.count() == 240 and evaluation.auc_ap(oof, "oof", "label").first()["auc"] > 0.9
    assert df.groupBy("src_iri").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    strat = learn.stratified_folds(df.drop("fold"), "label", ["k"], 3)
    assert strat.groupBy("fold").count().count() == 3
    comps = spark.createDataFrame([(f"c{k}",) for k in range(9) for _ in range(k + 1)], "c string")
    folds = comps.join(learn.balanced_folds(comps, "c", 3), "c").groupBy("fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 9
    best = learn.search(df.filter("fold = 0"), df.filter("fold = 1"), ["x", "y"], [{"maxIter": 2, "maxDepth": 2}, {"maxIter": 1, "maxDepth": 1}], threads=1)
    assert best[0]["f1"] >= best[1]["f1"] and len(learn.trials(7)) == 30 and learn.trials(7) == learn.trials(7)
    ens = learn.soft_ensemble(oof.withColumn("noise", F.rand(1)), ["k"], ["oof", "noise"])
    assert evaluation.auc_ap(ens, "ensemble", "label").first()["auc"] > 0.8


def test_retrieval_selectors(spark):
    m = spark.createDataFrame([(1, 100, 9, 0.90), (2, 50, 8, 0.80), (3, 300, 10, 1.0), (4, 200, 10, 0.999)], "id int, n_candidates int, n_hits int, recall double")
    assert retrieval.smallest_above_recall(m).first()["id"] == 1 and retrieval.smallest_near_best(m).first()["id"] == 4
    assert retrieval.smallest_above_recall(m, 1.1).first()["id"] == 3 and retrieval.best_under_budget(m).first()["id"] == 4


def test_run_pair(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    labels = [" ".join(rng.sample(words, 3)) for _ in range(14)]
    src = spark.createDataFrame([(f"s{k:02d}", x, x) for k, x in enumerate(labels)], "iri string, label string, document string")
    tgt = spark.createDataFrame([(f"t{k:02d}", " ".join(reversed(x.split())), x) for k, x in enumerate(labels)], "iri string, label string, document string")
    gold = spark.createDataFrame([(f"s{k:02d}", f"t{k:02d}") for k in range(14)], "src_iri string, tgt_iri string")
    cfg = config.PairConfig(scorer=config.ScorerConfig(kind="logistic", folds=2))
    from unittest.mock import patch

    with patch.object(learn, "estimator", lambda kind, names, label="label", **_: learn_estimator(kind, names, label)):
        out = pipeline.run_pair(src, tgt, gold, dense.HashingEncoder(16), cfg)
    assert out["metrics"].first()["recall"] > 0.7 and out["matches"].count() > 8
    assert config.parse_grid("1, 2,2") == [1, 2] and config.PairConfig(pair="A_b").name() == "a-b" and config.safe_name("x/y z") == "y_z"


learn_estimator = learn.estimator


def test_stream(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/candidates.parquet").repartition(3)
    src.write.parquet(str(tmp_path / "in"))
    stream = scoring.pair_stream(spark, str(tmp_path / "in"), src.schema)
    q = scoring.score_batches(scoring.fresh_pairs(stream, late="90 days"), lambda df: df.select("src_iri", "tgt_iri"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == src.filter("src_iri IS NOT NULL AND tgt_iri IS NOT NULL").select("src_iri", "tgt_iri").distinct().count()


def test_greedy_in_ranges(spark, monkeypatch):
    """A chain that rounds shorten by one edge each is finished range by range, as in sequence."""
    from brindle.operators import matching

    monkeypatch.setattr(matching, "RANGE", 7)
    n = 60
    edges = [(f"s{k:02d}", f"t{k:02d}", float(2 * n - 2 * k)) for k in range(n)] + [(f"s{k + 1:02d}", f"t{k:02d}", float(2 * n - 2 * k - 1)) for k in range(n - 1)]
    want, s, t = [], set(), set()
    for a, b, x in sorted(edges, key=lambda e: -e[2]):
        if a not in s and b not in t:
            want.append((a, b))
            s.add(a)
            t.add(b)
    got = matching.greedy(spark.createDataFrame(edges, "src_iri string, tgt_iri string, score double"), max_rounds=2)
    assert sorted((r["src_iri"], r["tgt_iri"]) for r in got.collect()) == sorted(want)


def test_pruned_top_k_against_every_pair(spark, monkeypatch):
    from brindle.operators import retrieval

    monkeypatch.setattr(retrieval, "CROWD", 5)
    monkeypatch.setattr(retrieval, "TIER", 2.0)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([3, 10, 30])]) for _ in range(rng.randint(1, 6)))
    q, c = [(f"s{k}", text()) for k in range(40)] + [("none", ""), ("other", "zzz")], [(f"t{k}", text()) for k in range(60)]
    got = retrieval.top_token_overlap(spark.createDataFrame(q, "iri string, x string"), spark.createDataFrame(c, "iri string, x string"), "iri", "x", 4).collect()
    want = []
    for i, a in q:
        a = set(a.split())
        rows = [(-len(a & set(b.split())), -len(a & set(b.split())) / len(a | set(b.split())), abs(len(a) - len(set(b.split()))), j) for j, b in c if a & set(b.split())]
        for r in sorted(sorted(rows, key=lambda r: r[3], reverse=True), key=lambda r: r[:3])[:4]:
            want.append((i, r[3], -r[0]))
    assert sorted((r["src_iri"], r["tgt_iri"], r["n_common"]) for r in got) == sorted(want)
    empty = spark.createDataFrame([], "iri string, x string")
    assert retrieval.top_token_overlap(empty, spark.createDataFrame(c, "iri string, x string"), "iri", "x", 4).count() == 0


def test_alignability(spark):
    from brindle.operators import alignability

    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        y = k % 2
        rows += [(f"s{k}", f"t{k}-{j}", float(np.clip(rng.normal(0.8 if y and j == 0 else 0.3, 0.1), 0, 1)), int(y and j == 0)) for j in range(4)]
    df = spark.createDataFrame(rows, "src_iri string, tgt_iri string, score double, label int")
    real = entity.entity_table(df, "src_iri", label="label")
    t = entity.with_counterfactuals(real, entity.counterfactuals(df, "src_iri", "score", "label")).cache()
    assert t.count() == 60 + 20 and t.filter("is_counterfactual").agg(F.min("rank__feat__max"), F.max("rank__feat__max")).first()[1] <= 1
    feats = ["feat__max", "feat__gap12", "rank__feat__max", "rank__feat__gap12"]
    spec = {"logistic": ("logistic", {"C": 1.0, "maxIter": 30}), "forest": ("random_forest", {"numTrees": 5, "bootstrap": False}), "boosted": ("gbt", {"maxIter": 3, "maxDepth": 2})}
    scores, perf, weights = alignability.cross_fit(t, feats, spec, folds=2)
    auc = {r["model"]: r["auc"] for r in perf.collect()}
    assert set(auc) == {*spec, "rank_ensemble", "mixture", "soft_ensemble"} and min(auc.values()) > 0.85 and sum(weights.values()) == pytest.approx(1)
    assert scores.count() == 80
    again = alignability.refit_predict(t, real, feats, "soft_ensemble", weights, spec)
    assert again.count() == 60
    assert len(alignability.candidate_models()) == 18


def test_gate_grid_against_counting(spark):
    from brindle.operators import alignability

    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.choice([0.0, 0.05, 0.2, 0.45, 0.6, 1.0]), rng.random()) for _ in range(80)]
    sweep = alignability.gate_grid(spark.createDataFrame(rows, "label int, src__m double, tgt__m double"), 50, ["m"], ["m"]).collect()
    assert len(sweep) == 4 * 13 + 2 * 13 * 13
    rule = {"src_only": lambda s, t, a, b: s >= a, "tgt_only": lambda s, t, a, b: t >= b, "hard_and": lambda s, t, a, b: s >= a and t >= b, "low_low_veto": lambda s, t, a, b: s >= a or t >= b, "min_rank": lambda s, t, a, b: min(s, t) >= a, "geomean_rank": lambda s, t, a, b: (s * t) ** 0.5 >= a}
    for r in sweep:
        kept = [y for y, s, t in rows if rule[r["gate"]](s, t, r["q_src"], r["q_tgt"])]
        assert (r["n"], r["tp"]) == (len(kept), sum(kept))


def test_keys_above_the_ceiling_are_split(spark):
    from brindle.operators import skew

    assert skew.hot_limit(10**12) == skew.CEILING and skew.hot_limit(100) == skew.LEAST_ROWS
    big = spark.createDataFrame([("a", k) for k in range(50)] + [("b", k) for k in range(3)] + [(None, 1)], "k string, v int")
    hot = skew.hot_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", ceiling=10)
    assert hot.collect() == [("a", 5)]
    small = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, w string")
    assert skew.salted_join(big, small, "k", hot, F.col("v")).count() == 53
    both = spark.createDataFrame([("a", k) for k in range(7)] + [("c", 1)], "k string, w int")
    parts = spark.createDataFrame([("a", 5, 2)], "k string, a int, b int")
    met = skew.crossed_join(big, both, "k", parts, F.col("v"), F.col("w"))
    assert met.count() == 350 and met.distinct().count() == 350


def test_running_over_parts(spark):
    from brindle.operators.running import running

    rng = random.Random(6)
    rows = [(k, rng.randint(-5, 9)) for k in range(300)]
    got = running(spark.createDataFrame(rows, "k int, v int"), [F.desc("k")], sums={"s": F.col("v")}, mins={"m": F.col("v")}, parts=5).collect()
    total, least, want = 0, 99, {}
    for k, v in reversed(rows):
        total, least = total + v, min(least, v)
        want[k] = (total, least)
    assert {r["k"]: (r["s"], r["m"]) for r in got} == want
    assert running(spark.createDataFrame([], "k int, v int"), [F.asc("k")], sums={"s": F.col("v")}).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    """Only a local master may fall back to a temporary folder."""
    from types import SimpleNamespace

    from brindle.sources import materialize

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        materialize.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))


def links(rng, n=40, odd=0.25):
    """A forest with some further parents, a loop and unknown ends."""
    rows = [(f"n{k}", f"n{rng.randrange(max(1, k // 3))}") for k in range(1, n)]
    rows += [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(odd * n))]
    return [*rows, rows[3], ("n7", "n7"), (None, "n1"), ("n2", None)]


def kin(rows):
    """Siblings and cousins pair by pair."""
    e = {(c, p) for c, p in rows if c is not None and p is not None}
    sib = {(a, b) for a, p in e for b, q in e if p == q and a != b}
    cous = {(x, y) for x, p in e for s, q in sib if s == p for y, r in e if r == q and x != y} - sib
    return sib, cous


def sizes(pairs):
    out = {}
    for x, _ in pairs:
        out[x] = out.get(x, 0) + 1
    return out


@pytest.mark.parametrize("odd", [0, 0.05, 0.3])
def test_cousin_counts_against_every_pair(spark, odd):
    rows = links(random.Random(11), 45, odd)
    got = ontology.cousin_counts(spark.createDataFrame(rows, "child string, parent string")).collect()
    want = sizes(kin(rows)[1])
    assert len(got) == len(want) and {r["iri"]: r["n"] for r in got} == want


def test_cousins_of_a_tree_are_counted_without_pairs(spark):
    """1.8 thousand million pairs, which no test could wait for if they were listed."""
    e = spark.range(60_000).select(F.concat(F.lit("c"), "id").alias("child"), F.concat(F.lit("p"), F.col("id") % 2).alias("parent"))
    e = e.unionByName(spark.createDataFrame([("p0", "r"), ("p1", "r")], "child string, parent string"))
    assert ontology.cousin_counts(e).agg(F.count(F.lit(1)), F.sum("n")).first() == (60_000, 1_800_000_000)


@pytest.mark.parametrize("odd", [0, 0.05, 0.3])
def test_relation_sizes_against_every_pair(spark, odd):
    """As many pairs and entities of each relation as `relations` lists, with cycles too."""
    e = spark.createDataFrame(links(random.Random(12), 45, odd), "child string, parent string")
    want = ontology.relations(e).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("iri").alias("n_entities"))
    assert sorted(map(tuple, ontology.relation_sizes(e).collect())) == sorted(map(tuple, want.collect()))


def test_relation_groups_counts_orders(spark, data):
    """The level of orders is part of the hierarchy."""
    from brindle.plans import queries, views

    got = {r["relation"]: r for r in queries.relation_groups(spark, data).collect()}
    n = views.table(spark, data, "orders").filter("o_orderkey IS NOT NULL AND o_custkey IS NOT NULL").select("o_orderkey").distinct().count()
    assert got["ancestor_d3"]["n_entities"] == n and got["ancestor_d1"]["n_entities"] > n


@pytest.mark.parametrize("odd", [0, 0.3])
def test_siblings_in_lists_against_every_pair(spark, monkeypatch, odd):
    """Parents whose children are dealt into several lists, and pairs that two parents share."""
    monkeypatch.setattr(ontology, "FAMILY", 3)
    rows = links(random.Random(13), 45, odd)
    got = ontology.siblings(spark.createDataFrame(rows, "child string, parent string")).collect()
    assert sorted(map(tuple, got)) == sorted(kin(rows)[0])


def test_siblings_of_orders(spark, data):
    """Orders of one customer are siblings."""
    from brindle.plans import queries, views

    o = views.table(spark, data, "orders").filter("o_orderkey IS NOT NULL AND o_custkey IS NOT NULL").select("o_custkey", "o_orderkey").distinct()
    n = o.groupBy("o_custkey").count().agg(F.sum(F.expr("count * (count - 1)"))).first()[0]
    assert n > 0 and queries.siblings(spark, data).filter("iri LIKE 'o%'").count() == n


def test_pruned_cosine_against_every_pair(spark, monkeypatch):
    """The bound from what is left on both sides loses no pair."""
    monkeypatch.setattr(retrieval, "TIER", 2.0)
    rng = random.Random(4)
    rows = lambda p, n: [(f"{p}{k}", t, x / sum(v * v for v in w) ** 0.5) for k in range(n) for w in [[rng.random() + 0.1 for _ in range(5)]] for t, x in zip(rng.sample(range(25), 5), w)]
    q, c = rows("s", 30), rows("t", 50)
    got = retrieval.top_tfidf(spark.createDataFrame(q, "iri string, term int, weight double"), spark.createDataFrame(c, "iri string, term int, weight double"), 3, digits=9).collect()
    all_ = {}
    for a, t, x in q:
        for b, u, y in c:
            if t == u:
                all_[a, b] = all_.get((a, b), 0) + x * y
    want = {(a, b) for a in {i for i, _ in all_} for _, b in sorted((-round(x, 9), j) for (i, j), x in all_.items() if i == a)[:3]}
    assert {(r["src_iri"], r["tgt_iri"]) for r in got} == want
