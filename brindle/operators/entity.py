"""Entity-level statistics of a scored bipartite graph, alignability gates and rank ensembles.

The 54 statistics of an entity come from its distinct scores with their counts. One global order, cumulated over
range partitions, gives every value its positions, hence quantiles and top scores; entropies are sums in
closed form. Everything is pre-aggregated, so no task ever holds the scores of one entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.evaluation import auc_ap
from brindle.operators.ranking import ecdf_long, pct_rank_long, pct_ranks
from brindle.operators.running import running
from brindle.operators.skew import hot_keys, salted_join
from brindle.sources.materialize import write_table

TINY = 1e-12
# Softmax temperatures, quantiles, fractions of the top score; gate names, grids and recall floors.
TEMPERATURES = (0.05, 0.10, 0.20, 0.50, 1.00)
QUANTILES = (0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
FRACTIONS = (0.90, 0.75, 0.50)
GATES = ("none", "src_only", "tgt_only", "hard_and", "low_low_veto", "min_rank", "geomean_rank")
V3_GRID = (0.0, 0.025, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
MODEL_GRID = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50)
TIERS = {"SAFE": 0.995, "BALANCED": 0.980, "AGGRESSIVE": 0.950}


def finite(c: Column) -> Column:
    """A number; null, NaN and infinite ones are 0."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def entity_statistics(scored: DataFrame, entity: str, score: str = "score", threshold: float = 0.5, label: str | None = None) -> DataFrame:
    """One row per entity with its 54 statistics, feat__*, (and label, the highest of its rows).

    Unusable scores count as 0, absent top scores too. Rows without an entity take no part; an empty table gives an empty one.
    """
    rows = scored.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), finite(F.col(score)).alias("s"), *([F.col(label).alias("label")] if label else []))
    steps = rows.groupBy("entity", "s").agg(F.count(F.lit(1)).alias("c"), *([F.max("label").alias("label")] if label else []))
    steps = write_table(running(steps, [F.asc("entity"), F.asc("s")], sums={"upto": F.col("c")}), "entity-steps").df
    firsts = [F.sum("c").alias("n"), F.max("s").alias("top"), F.min("s").alias("low"), (F.sum(F.col("c") * F.col("s")) / F.sum("c")).alias("mean"), F.min(F.col("upto") - F.col("c")).alias("start"), F.count(F.lit(1)).alias("steps")]
    first = steps.groupBy("entity").agg(*firsts, *([F.max("label").alias("label")] if label else []))
    d = salted_join(steps.drop("label"), first.drop("steps", "label"), "entity", hot_keys(first, "entity", n="steps"), F.col("s"))
    s, c, n = F.col("s"), F.col("c"), F.col("n")
    begin, end = F.col("upto") - c - F.col("start"), F.col("upto") - F.col("start")
    at = lambda p: F.max(F.when((begin <= p) & (p < end), s))  # noqa: E731  the value at an ascending position
    mass = F.greatest(s, F.lit(0.0))
    aggs = [F.sum(c * mass).alias("mass"), F.sum(F.when(mass > 0, c * mass * F.log(mass))).alias("mlogm"), F.sum(c * mass * mass).alias("m2"), F.sqrt(F.sum(c * (s - F.col("mean")) * (s - F.col("mean"))) / F.sum(c)).alias("std")]
    aggs += [at(n - k).alias(f"t{k}") for k in (1, 2, 3, 4, 5, 10)]
    for q in QUANTILES:
        h = F.lit(q) * (n - 1)
        aggs += [at(F.floor(h)).alias(f"a{round(q * 100)}"), at(F.ceil(h)).alias(f"b{round(q * 100)}")]
    for t in TEMPERATURES:
        z = F.greatest(F.lit(-60.0), (s - F.col("top")) / t)
        aggs += [F.sum(c * F.exp(z)).alias(f"e{round(t * 100)}"), F.sum(c * F.exp(z) * z).alias(f"z{round(t * 100)}")]
    aggs += [F.sum(F.when(s >= f * F.col("top"), c).otherwise(0)).cast("double").alias(f"ge{round(f * 100)}") for f in FRACTIONS]
    g = d.groupBy("entity", "n", "top", "low", "mean").agg(*aggs)
    if label:
        g = g.join(first.select("entity", "label"), "entity")

    n, top, low, mean, std = F.col("n").cast("double"), F.col("top"), F.col("low"), F.col("mean"), F.col("std")
    t = {k: F.coalesce(F.col(f"t{k}"), F.lit(0.0)) for k in (1, 2, 3, 4, 5, 10)}
    over = F.greatest(F.abs(top), F.lit(TINY))
    quantile = {}
    for q in QUANTILES:
        lo, hi, k = F.col(f"a{round(q * 100)}"), F.col(f"b{round(q * 100)}"), F.lit(q) * (F.col("n") - 1)
        quantile[q] = lo + (hi - lo) * (k - F.floor(k))
    massive = F.col("mass") > TINY
    share = lambda k: F.when(massive, sum((F.greatest(t[j], F.lit(0.0)) for j in range(2, k + 1)), F.greatest(t[1], F.lit(0.0))) / F.col("mass")).otherwise(F.least(F.lit(float(k)), n) / n)
    entropy = F.when(massive, F.log("mass") - F.coalesce(F.col("mlogm"), F.lit(0.0)) / F.col("mass")).otherwise(F.log(n))
    hhi = F.when(massive, F.col("m2") / (F.col("mass") * F.col("mass"))).otherwise(1.0 / n)
    scaled = lambda h: F.when(n > 1, h / F.log(n)).otherwise(F.lit(0.0))
    cols = {
        "count": n, "max": top, "min": low, "mean": mean, "median": quantile[0.50], "std": std, "range": top - low, "cv": std / F.greatest(F.abs(mean), F.lit(TINY)),
        **{f"q{round(q * 100)}": v for q, v in quantile.items()},
        **{f"top{k}": t[k] for k in (1, 2, 3, 5, 10)},
        **{f"gap1{k}": top - t[k] for k in (2, 3, 5, 10)},
        **{f"relative_gap1{k}": (top - t[k]) / over for k in (2, 3, 5)},
        **{f"top{k}_ratio": t[k] / over for k in (2, 3, 5)},
        "top_z": (top - mean) / F.greatest(std, F.lit(TINY)), "mass_entropy": entropy, "mass_entropy_norm": scaled(entropy), "hhi": hhi, "effective_n": 1.0 / F.greatest(hhi, F.lit(TINY)),
    }
    for x in TEMPERATURES:
        e, z = F.col(f"e{round(x * 100)}"), F.col(f"z{round(x * 100)}")
        h = F.when(n > 1, F.log(e) - z / e).otherwise(F.lit(0.0))
        cols |= {f"soft_entropy_t{round(x * 100):03d}": h, f"soft_entropy_norm_t{round(x * 100):03d}": scaled(h)}
    cols |= {f"top{k}_mass": share(k) for k in (1, 2, 3, 5)} | {f"count_ge_{round(f * 100):03d}top": F.col(f"ge{round(f * 100)}") for f in FRACTIONS}
    cols |= {"max_minus_thr": top - threshold, "mean_minus_thr": mean - threshold, "min_minus_thr": low - threshold}
    return g.select("entity", *([F.col("label")] if label else []), *[v.alias(f"feat__{k}") for k, v in cols.items()])


def entity_table(scored: DataFrame, entity: str, score: str = "score", threshold: float = 0.5, label: str | None = None, digits: int | None = None) -> DataFrame:
    """Statistics and their percent ranks over all entities; with `digits` rounded values are ranked."""
    base = entity_statistics(scored, entity, score, threshold, label)
    feats = [c for c in base.columns if c.startswith("feat__")]
    base = write_table(base, "entity-statistics").df
    ranked = base if digits is None else base.withColumns({f: F.round(f, digits) for f in feats})
    return base.join(pct_ranks(ranked, ["entity"], feats), "entity")


def counterfactuals(scored: DataFrame, entity: str, score: str, label: str, threshold: float = 0.5, ratio: float = 0.5, floor: int = 20, weight: float = 0.25) -> DataFrame:
    """Statistics of entities that have a right row, without their right rows: negatives of low weight, at most max(floor,
    ratio x positives), by hash. Their percent ranks are those of `with_counterfactuals`."""
    pos = scored.filter(F.col(label) == 1).select(entity).distinct()
    n = pos.count()
    rest = scored.join(pos, entity, "left_semi").filter(F.coalesce(F.col(label), F.lit(0)) != 1)
    t = entity_statistics(rest, entity, score, threshold)
    t = t.orderBy(F.xxhash64("entity"), "entity").limit(max(floor, round(ratio * n)))
    return t.withColumn("label", F.lit(0)).withColumn("sample_weight", F.lit(weight)).withColumn("is_counterfactual", F.lit(True))


def with_counterfactuals(real: DataFrame, extra: DataFrame) -> DataFrame:
    """`real` (entity_table's output with a label) and counterfactual rows together, with group_id, sample_weight and
    is_counterfactual. Ranks of the extra rows are read off the real ones' distribution, which they don't change."""
    feats = [c for c in real.columns if c.startswith("feat__")]
    long = lambda df: df.unpivot(["entity"], feats, "feature", "value")
    ranks = ecdf_long(long(extra), long(real)).groupBy("entity").pivot("feature", feats).agg(F.max("cdf")).withColumnsRenamed({f: f"rank__{f}" for f in feats})
    cf = extra.join(ranks, "entity").withColumn("group_id", F.col("entity")).withColumn("entity", F.concat(F.lit("CF::"), "entity"))
    own = real.withColumns({"group_id": F.col("entity"), "sample_weight": F.lit(1.0), "is_counterfactual": F.lit(False), "label": F.col("label").cast("int")})
    return own.unionByName(cf.withColumn("label", F.col("label").cast("int")).select(own.columns))


def v3_confidence(scored: DataFrame, entity: str, score: str = "score", digits: int | None = 9) -> DataFrame:
    """(entity, confidence): mean percent rank of the best score, its lead, its relative lead and its z-value, rounded to
    `digits` so that values that differ by the order of summing tie."""
    r = scored.filter(F.col(entity).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(F.col(entity).alias("entity"), F.col(score).cast("double").alias("s"))
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("s"))))
    a = r.groupBy("entity").agg(F.max("s").alias("top1"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("s"))), F.lit(0.0)).alias("top2"), F.avg("s").alias("m"), F.stddev_pop("s").alias("sd"))
    a = a.withColumn("gap", F.col("top1") - F.col("top2")).withColumn("rel_gap", F.col("gap") / F.greatest(F.abs("top1"), F.lit(TINY))).withColumn("top_z", (F.col("top1") - F.col("m")) / F.greatest("sd", F.lit(TINY)))
    names = ["top1", "gap", "rel_gap", "top_z"]
    a = a if digits is None else a.withColumns({c: F.round(c, digits) for c in names})
    p = pct_ranks(write_table(a.select("entity", *names), "entity-leads").df, ["entity"], names, "r_")
    return p.select("entity", ((F.col("r_top1") + F.col("r_gap") + F.col("r_rel_gap") + F.col("r_top_z")) / 4).alias("confidence"))


def attach_confidence(pairs: DataFrame, score: str = "score") -> DataFrame:
    """With src_conf and tgt_conf; 0 for entities without a score."""
    s, t = v3_confidence(pairs, "src_iri", score), v3_confidence(pairs, "tgt_iri", score)
    out = pairs.join(s.select(F.col("entity").alias("src_iri"), F.col("confidence").alias("src_conf")), "src_iri", "left").join(t.select(F.col("entity").alias("tgt_iri"), F.col("confidence").alias("tgt_conf")), "tgt_iri", "left")
    return out.na.fill(0.0, ["src_conf", "tgt_conf"])


def gate(kind: str, q: float, q_tgt: float | None = None, src: str = "src_conf", tgt: str = "tgt_conf") -> Column:
    """Whether a pair passes: by one side, both sides, either side, the lower side, or the geometric mean of both."""
    s, t = F.col(src), F.col(tgt)
    qt = q if q_tgt is None else q_tgt
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return {
        "none": F.lit(True), "src_only": s >= q, "tgt_only": t >= qt, "hard_and": (s >= q) & (t >= qt),
        "low_low_veto": (s >= q) | (t >= qt), "min_rank": F.least(s, t) >= q, "geomean_rank": F.sqrt(clip(s) * clip(t)) >= q,
    }[kind]


def gate_sweep(pairs: DataFrame, gold: DataFrame, grid: Sequence[float] = V3_GRID, src: str = "src_conf", tgt: str = "tgt_conf") -> DataFrame:
    """(gate, q, n, tp, precision, recall, f1, recall_ratio): every gate at every q, as conditional counts in one pass."""
    total_gold = gold.select("src_iri", "tgt_iri").distinct().count()
    d = pairs.join(gold.select("src_iri", "tgt_iri").distinct().withColumn("hit", F.lit(1)), ["src_iri", "tgt_iri"], "left")
    rows = []
    for kind in GATES:
        for q in (0.0,) if kind == "none" else grid:
            ok = gate(kind, q, src=src, tgt=tgt)
            rows.append(F.struct(F.lit(kind).alias("gate"), F.lit(float(q)).alias("q"), F.count(F.when(ok, 1)).alias("n"), F.count(F.when(ok & F.col("hit").isNotNull(), 1)).alias("tp")))
    s = d.agg(F.array(*rows).alias("x"), F.count("hit").alias("base")).select("base", F.explode("x").alias("x")).select("base", "x.*")
    s = s.withColumn("precision", F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(F.lit(0.0))).withColumn("recall", F.col("tp") / F.lit(float(max(total_gold, 1))))
    s = s.withColumn("f1", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("n") + F.lit(total_gold))).otherwise(F.lit(0.0)))
    return s.withColumn("recall_ratio", F.when(F.col("base") > 0, F.col("tp") / F.col("base")).otherwise(F.lit(1.0))).drop("base")


def choose_tiers(sweep: DataFrame, tiers: dict[str, float] = TIERS) -> DataFrame:
    """(tier, gate, q, ...): for each recall floor the gate with the best F1, then precision, recall, fewest pairs and highest
    q; where none reaches the floor, the one that loses least recall."""
    out = None
    for tier, floor in tiers.items():
        ok = F.col("recall_ratio") >= floor - TINY
        order = [F.when(ok, F.col(c)).desc_nulls_last() for c in ("f1", "precision", "recall")]
        one = sweep.orderBy(ok.desc(), F.when(~ok, F.col("recall_ratio")).desc_nulls_last(), *order, "n", F.desc("q"), "gate").limit(1).withColumn("tier", F.lit(tier))
        out = one if out is None else out.unionByName(one)
    return out.select("tier", *sweep.columns)


def apply_tiers(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """`pairs` once for each tier whose gate they pass. `chosen` has one row per tier."""
    out = None
    for r in chosen.collect():
        one = pairs.filter(gate(r["gate"], r["q"])).withColumn("tier", F.lit(r["tier"]))
        out = one if out is None else out.unionByName(one)
    return out


def rank_ensemble_fit(table: DataFrame, features: Sequence[str], label: str = "label", least: float = 0.05, most: int = 10) -> dict[str, float]:
    """The lead of each feature used: AUC - 0.5, of those that separate by `least` or more; without any, of the `most` best."""
    stats = auc_ap(table.unpivot(["entity", label], list(features), "feature", "value"), "value", label, ["feature"]).select("feature", (F.col("auc") - 0.5).alias("lead"))
    rows = {r["feature"]: float(r["lead"]) for r in stats.collect()}  # one row per feature
    return {f: x for f, x in rows.items() if abs(x) >= least} or dict(sorted(rows.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:most])


def rank_ensemble_predict(leads: dict[str, float], table: DataFrame) -> DataFrame:
    """(entity, score): weighted mean of percent ranks within `table`, turned so that positives are high."""
    ranked = pct_rank_long(table.unpivot(["entity"], list(leads), "feature", "value"))
    lead = F.create_map(*[x for f, v in leads.items() for x in (F.lit(f), F.lit(v))])[F.col("feature")]
    turned = F.when(lead >= 0, F.col("r")).otherwise(1 - F.col("r"))
    weight = F.greatest(F.abs(lead), F.lit(1e-9))
    return ranked.groupBy("entity").agg((F.sum(turned * weight) / F.sum(weight)).alias("score"))


def rank_ensemble(table: DataFrame, features: Sequence[str], label: str = "label", least: float = 0.05, most: int = 10) -> DataFrame:
    """(entity, score) of an ensemble fitted on the same table."""
    return rank_ensemble_predict(rank_ensemble_fit(table, features, label, least, most), table)
