"""Which entities have a partner at all: learners over entity statistics, cross-fitted, and the gates made of them.

A learner maps an entity's statistics to the probability that it has a partner; its out-of-fold scores, as
percent ranks, become the confidence of the entity's pairs. All learners are Spark ML models, or
sums over percent ranks, or a diagonal mixture whose sums are aggregated; nothing is fitted on one machine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import entity, learn
from brindle.operators.evaluation import auc_ap
from brindle.operators.ranking import pct_ranks
from brindle.sources.materialize import write_table

# The learners' settings.
LOGISTIC_C = (0.1, 1.0, 10.0)
LEAVES, DEPTHS = (1, 2, 4), (None, 10, 20)
BOOSTED = ((350, 3, 0.03, 1, 0.90, 0.90), (500, 4, 0.03, 1, 0.85, 0.90), (700, 5, 0.02, 2, 0.80, 0.85), (450, 6, 0.025, 4, 0.90, 0.75), (800, 4, 0.015, 1, 0.75, 1.00), (600, 3, 0.02, 2, 1.00, 0.80))


def candidate_models(trees: int = 700) -> dict[str, tuple[str, dict]]:
    """name -> (kind, parameters) of the 18 learners. Spark has neither extremely randomised trees, for which forests
    without resampling stand in (at most 30 deep, Spark's limit), nor XGBoost's penalties on leaves (left out)."""
    out: dict[str, tuple[str, dict]] = {}
    for c in LOGISTIC_C:
        out[f"logistic_C{c:g}"] = ("logistic", {"C": c, "maxIter": 400})
    for leaf in LEAVES:
        for depth in DEPTHS:
            out[f"forest_leaf{leaf}_depth{depth}"] = ("random_forest", {"numTrees": trees, "minInstancesPerNode": leaf, "maxDepth": depth or 30, "featureSubsetStrategy": "sqrt", "bootstrap": False})
    for i, (n, depth, rate, child, rows, cols) in enumerate(BOOSTED):
        out[f"boosted_{i:02d}"] = ("gbt", {"maxIter": n, "maxDepth": depth, "stepSize": rate, "minInstancesPerNode": child, "subsamplingRate": rows, "featureSubsetStrategy": str(cols)})
    return out


class DiagonalMixture:
    """Two Gaussians with diagonal covariance, fitted by expectation-maximisation; every step is one aggregation."""

    def __init__(self, columns: Sequence[str], prior: list[float], means: list[list[float]], variances: list[list[float]]):
        self.columns, self.prior, self.means, self.variances = list(columns), prior, means, variances
        self.positive = 1

    def posterior(self, k: int):
        """P(component k | row) as an expression."""
        logs = []
        for j in (0, 1):
            out = F.lit(math.log(max(self.prior[j], 1e-12)))
            for c, m, v in zip(self.columns, self.means[j], self.variances[j]):
                d = entity.finite(F.col(c)) - F.lit(m)
                out = out - d * d / F.lit(2 * v) - F.lit(0.5 * math.log(v))
            logs.append(out)
        return 1 / (1 + F.exp(F.least(F.greatest(logs[1 - k] - logs[k], F.lit(-60.0)), F.lit(60.0))))

    def predict(self, table: DataFrame, name: str = "score") -> DataFrame:
        return table.withColumn(name, self.posterior(self.positive))


def mixture_fit(table: DataFrame, features: Sequence[str], label: str = "label", most: int = 30, steps: int = 30, floor: float = 1e-5) -> DiagonalMixture:
    """A diagonal mixture over the `most` columns that separate the label best, started from the rows above and below the
    mean of their turned values; the positive component holds more of the label's mass."""
    stats = auc_ap(table.unpivot(["entity", label], list(features), "feature", "value"), "value", label, ["feature"]).collect()  # a row per feature
    best = sorted(((max(r["auc"], 1 - r["auc"]), r["feature"], r["auc"] >= 0.5) for r in stats), key=lambda x: (-x[0], x[1]))[:most]
    cols = [f for _, f, _ in best]
    turned = sum((F.col(f) if up else 1 - F.col(f) for _, f, up in best), F.lit(0.0)) / max(len(best), 1)
    middle = table.agg(F.avg(turned)).first()[0] or 0.0

    def sums(w) -> list:
        x = [F.col(c) for c in cols]
        return [F.sum(w), *[F.sum(w * v) for v in x], *[F.sum(w * v * v) for v in x]]

    table, model = write_table(table.select(label, *[entity.finite(F.col(c)).alias(c) for c in cols]), "mixture-rows").df, None
    for _ in range(steps):
        w = F.when(turned > middle, F.lit(1.0)).otherwise(F.lit(0.0)) if model is None else model.posterior(1)
        weighted = table.select(*cols, w.alias("_w"))  # the posterior once a row, not once a sum
        r = list(weighted.agg(*[a.alias(f"a{i}") for i, a in enumerate(sums(1 - F.col("_w")) + sums(F.col("_w")))]).first())
        half, k = len(r) // 2, len(cols)
        parts = [r[:half], r[half:]]
        n = [max(p[0] or 0.0, 1e-9) for p in parts]
        means = [[(p[1 + i] or 0.0) / n[j] for i in range(k)] for j, p in enumerate(parts)]
        variances = [[max((p[1 + k + i] or 0.0) / n[j] - means[j][i] ** 2, 0.0) + floor for i in range(k)] for j, p in enumerate(parts)]
        new = DiagonalMixture(cols, [x / sum(n) for x in n], means, variances)
        still = model is not None and max(abs(a - b) for x, y in zip(new.means, model.means) for a, b in zip(x, y)) < 1e-5
        model = new
        if still:
            break
    mass = table.agg(*[(F.sum(model.posterior(k) * F.col(label)) / F.sum(model.posterior(k))).alias(f"m{k}") for k in (0, 1)]).first()
    model.positive = 1 if (mass["m1"] or 0) >= (mass["m0"] or 0) else 0
    return model


def _fit_score(name: str, spec: dict[str, tuple[str, dict]], train: DataFrame, rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(entity, score) of `rows` by a learner fitted on `train`; a row's weight is its sample weight times its class weight."""
    if name == "rank_ensemble":
        return entity.rank_ensemble_predict(entity.rank_ensemble_fit(train, features, label), rows)
    if name == "mixture":
        ranks = [f for f in features if f.startswith("rank__")] or list(features)
        return mixture_fit(train, ranks, label).predict(rows).select("entity", "score")
    kind, params = spec[name]
    weighted = learn.class_weight(train, label).withColumn("weight", F.col("weight") * F.coalesce(F.col("sample_weight"), F.lit(1.0)))
    if "C" in params:  # the inverse penalty of the summed loss; Spark's is of its mean
        total = weighted.agg(F.sum("weight")).first()[0] or 1.0
        params = {k: v for k, v in params.items() if k != "C"} | {"regParam": 1.0 / (params["C"] * total)}
    return learn.score(learn.estimator(kind, features, label, **params).fit(weighted), rows, "score").select("entity", "score")


def cross_fit(table: DataFrame, features: Sequence[str], spec: dict[str, tuple[str, dict]] | None = None, folds: int = 5, label: str = "label", most: int = 5) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(scores, performance, weights) of every learner, the rank ensemble, the mixture and their soft ensemble.

    scores: entity, label, is_counterfactual and one out-of-fold column for each learner. performance: (model, auc, ap) over
    the real entities. weights: of the soft ensemble's members, the `most` best by average precision. `table` has
    entity, group_id, label, sample_weight, is_counterfactual; rows of one group are in one fold.
    """
    spec = candidate_models() if spec is None else spec
    names = [*spec, "rank_ensemble", "mixture"]
    t = write_table(table.withColumn("_fold", learn.group_fold("group_id", folds)), "crossfit").df
    out = t.select("entity", label, "is_counterfactual")
    for name in names:
        parts = None
        for f in range(folds):
            one = _fit_score(name, spec, t.filter(F.col("_fold") != f), t.filter(F.col("_fold") == f), features, label)
            parts = one if parts is None else parts.unionByName(one)
        out = write_table(out.join(parts.withColumnRenamed("score", name), "entity"), "crossfit-scores").df
    real = out.filter("NOT is_counterfactual")
    per = auc_ap(real.unpivot(["entity", label], names, "model", "value"), "value", label, ["model"]).select("model", "auc", "ap").collect()  # a row per learner
    best = sorted(per, key=lambda r: (-r["ap"], r["model"]))[:most]
    total = sum(max(r["ap"], 1e-6) for r in best)
    weights = {r["model"]: max(r["ap"], 1e-6) / total for r in best}
    out = write_table(_soft(out, weights), "crossfit-scores").df
    soft = auc_ap(out.filter("NOT is_counterfactual"), "soft_ensemble", label).first()
    rows = [*[(r["model"], r["auc"], r["ap"]) for r in per], ("soft_ensemble", soft["auc"], soft["ap"])]
    return out, table.sparkSession.createDataFrame(rows, "model string, auc double, ap double"), weights


def _soft(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    ranked = pct_ranks(scores, ["entity"], list(weights), "_r_")
    mix = sum((F.col(f"_r_{m}") * w for m, w in weights.items()), F.lit(0.0))
    return scores.join(ranked.select("entity", mix.alias("soft_ensemble")), "entity")


def refit_predict(train: DataFrame, rows: DataFrame, features: Sequence[str], name: str, weights: dict[str, float], spec: dict[str, tuple[str, dict]] | None = None, label: str = "label") -> DataFrame:
    """(entity, score) of unlabelled `rows` by the chosen learner, fitted on all of `train`."""
    spec = candidate_models() if spec is None else spec
    if name != "soft_ensemble":
        return _fit_score(name, spec, train, rows, features, label)
    out = rows.select("entity")
    for m in weights:
        out = out.join(_fit_score(m, spec, train, rows, features, label).withColumnRenamed("score", m), "entity")
    return _soft(write_table(out, "refit").df, weights).select("entity", F.col("soft_ensemble").alias("score"))


def gate_grid(pairs: DataFrame, gold_total: int, src_models: Sequence[str], tgt_models: Sequence[str], grid: Sequence[float] = entity.MODEL_GRID, label: str = "label") -> DataFrame:
    """(src_model, tgt_model, gate, q_src, q_tgt, n, tp, precision, recall, f1, recall_ratio) for every two models and every gate.

    `pairs` has label and the confidences src__MODEL and tgt__MODEL. Counts are made on the grid: a pair falls into one cell
    of (src level, tgt level, lower level, mean level) for each two models, of which there are a bounded number, and a
    gate is a sum over cells.
    """
    level = lambda c: sum((F.when(c >= q, 1).otherwise(0) for q in grid), F.lit(0))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    base = pairs.agg(F.count(F.when(F.col(label) == 1, 1))).first()[0]
    combos = F.explode(F.array(*[F.struct(F.lit(s).alias("src_model"), F.lit(t).alias("tgt_model"), F.col(f"src__{s}").alias("s"), F.col(f"tgt__{t}").alias("t")) for s in src_models for t in tgt_models]))
    d = pairs.select(label, combos.alias("x")).select(label, "x.*")
    cells = d.groupBy("src_model", "tgt_model", level(F.col("s")).alias("ls"), level(F.col("t")).alias("lt"), level(F.least("s", "t")).alias("lm"), level(F.sqrt(clip(F.col("s")) * clip(F.col("t")))).alias("lg"))
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(label) == 1, 1)).alias("tp"))
    points = [(k, float(q), float(q), i + 1, i + 1) for k in ("src_only", "tgt_only", "min_rank", "geomean_rank") for i, q in enumerate(grid)]
    points += [(k, float(a), float(b), i + 1, j + 1) for k in ("hard_and", "low_low_veto") for i, a in enumerate(grid) for j, b in enumerate(grid)]
    gates = pairs.sparkSession.createDataFrame(points, "gate string, q_src double, q_tgt double, i int, j int")
    s, t = F.col("ls") >= F.col("i"), F.col("lt") >= F.col("j")
    ok = F.when(F.col("gate") == "src_only", s).when(F.col("gate") == "tgt_only", t).when(F.col("gate") == "hard_and", s & t).when(F.col("gate") == "low_low_veto", s | t).when(F.col("gate") == "min_rank", F.col("lm") >= F.col("i")).otherwise(F.col("lg") >= F.col("i"))
    g = cells.crossJoin(F.broadcast(gates))  # bounded: cells of the grid by a fixed list of gates
    g = g.groupBy("src_model", "tgt_model", "gate", "q_src", "q_tgt").agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(ok, F.col("tp")).otherwise(0)).alias("tp"))
    g = g.withColumn("precision", F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(F.lit(0.0))).withColumn("recall", F.col("tp") / F.lit(float(max(gold_total, 1))))
    g = g.withColumn("f1", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("n") + F.lit(gold_total))).otherwise(F.lit(0.0)))
    return g.withColumn("recall_ratio", F.col("tp") / F.lit(float(base)) if base else F.lit(1.0))


def choose_gates(sweep: DataFrame, tiers: dict[str, float] = entity.TIERS) -> DataFrame:
    """For each recall floor the best row of `gate_grid` by F1, precision, recall, fewest pairs, highest q."""
    out = None
    for tier, floor in tiers.items():
        ok = F.col("recall_ratio") >= floor - 1e-12
        order = [F.when(ok, F.col(c)).desc_nulls_last() for c in ("f1", "precision", "recall")]
        one = sweep.orderBy(ok.desc(), F.when(~ok, F.col("recall_ratio")).desc_nulls_last(), *order, "n", F.desc("q_src"), F.desc("q_tgt"), "src_model", "tgt_model", "gate").limit(1).withColumn("tier", F.lit(tier))
        out = one if out is None else out.unionByName(one)
    return out.select("tier", *sweep.columns)
