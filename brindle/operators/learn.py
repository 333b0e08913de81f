"""Scorers with Spark ML: model families, folds, cross-fitting, search, stacking, mixtures.

Folds are functions of a hash, so a row's fold never depends on partitions. Models are fitted on vectors
assembled from a column list; class weights are the ratio of negatives to positives.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.evaluation import auc_ap
from brindle.operators.ranking import best_prefix

# Ranges of the parameter search.
SEARCH = {"maxIter": (40, 60, 80, 120), "maxDepth": (3, 4, 5, 6), "stepSize": (0.03, 0.05, 0.08, 0.1), "subsamplingRate": (0.6, 0.8, 1.0), "featureSubsetStrategy": ("sqrt", "onethird", "all"), "minInstancesPerNode": (1, 3, 5)}
ANCHORS = ({"maxIter": 60, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "onethird", "minInstancesPerNode": 1}, {"maxIter": 100, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "all", "minInstancesPerNode": 3})


def group_fold(key: str, k: int, seed: int = 42) -> Column:
    """Fold of a row by its group: all rows of a source are in one fold."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """With `fold`, dealt out in hash order within each label; buckets of the hash keep every window small."""
    d = df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_b", F.pmod("_h", F.lit(1024)))
    rn = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", *key))
    return d.withColumn("fold", F.pmod(rn + F.col("_b"), F.lit(k)).cast("int")).drop("_h", "_b")


def balanced_folds(components: DataFrame, component: str, k: int) -> DataFrame:
    """(component, fold): components, largest first, to the fold with the fewest rows. Sizes are counts of
    components of equal size dealt in turn, so no component list is collected: only distinct sizes are."""
    sizes = components.groupBy(component).agg(F.count(F.lit(1)).alias("size"))
    by_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("size")).collect()  # at most sqrt(2 x rows) distinct sizes
    load, start = [0] * k, {}
    for r in by_size:
        order = sorted(range(k), key=lambda f: (load[f], f))
        start[r["size"]] = order
        for i in range(k):
            load[order[i]] += r["size"] * (r["c"] // k + (1 if i < r["c"] % k else 0))
    orders = components.sparkSession.createDataFrame([(s, o) for s, o in start.items()], "size bigint, folds array<int>")
    rn = F.row_number().over(Window.partitionBy("size").orderBy(component)) - 1
    return sizes.withColumn("rn", rn).join(F.broadcast(orders), "size").select(component, F.get("folds", F.pmod("rn", F.lit(k)).cast("int")).alias("fold"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """With `weight`: negatives over positives for positives, 1 for negatives."""
    c = df.agg(F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(c[1]) / max(c[0], 1))).otherwise(F.lit(1.0)))


def estimator(kind: str, features: Sequence[str], label: str = "label", seed: int = 2026, **params) -> Pipeline:
    """gbt, random_forest or logistic over assembled columns with a weight column."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")]
    common = {"labelCol": label, "weightCol": "weight", "featuresCol": "_raw"}
    if kind == "gbt":
        stages.append(GBTClassifier(**common, seed=seed, **({"maxIter": 40, "maxDepth": 5, "stepSize": 0.1} | params)))
    elif kind == "random_forest":
        stages.append(RandomForestClassifier(**common, seed=seed, **({"numTrees": 60, "maxDepth": 8} | params)))
    elif kind == "logistic":
        stages.append(RobustScaler(inputCol="_raw", outputCol="_scaled", withCentering=True))
        stages.append(LogisticRegression(**(common | {"featuresCol": "_scaled"}), **({"regParam": 0.01, "maxIter": 60} | params)))
    else:
        raise ValueError(f"unknown model {kind}")
    return Pipeline(stages=stages)


def score(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """`df` with the probability of class 1."""
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("_raw", "_scaled", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, features: Sequence[str], n: int | None = None) -> DataFrame:
    """(feature, importance), highest first. As many rows as features."""
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    w = last.featureImportances if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients]
    df = SparkSession.getActiveSession().createDataFrame([(f, float(w[i])) for i, f in enumerate(features)], "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return df.limit(n) if n else df


def out_of_fold(df: DataFrame, kind: str, features: Sequence[str], fold: str, k: int, label: str = "label", **params) -> DataFrame:
    """`df` with `oof`: each row scored by a model that didn't see its fold."""
    out = None
    for f in range(k):
        rest = class_weight(df.filter(F.col(fold) != f), label)
        one = score(estimator(kind, features, label, **params).fit(rest), df.filter(F.col(fold) == f), "oof")
        out = one if out is None else out.unionByName(one)
    return out


def fold_metrics(scored: DataFrame, fold: str, value: str = "oof", label: str = "label") -> DataFrame:
    """(mean and population deviation of AUC and average precision over folds). One row."""
    m = auc_ap(scored, value, label, [fold])
    return m.agg(*[f(c).alias(f"{n}_{c}") for c in ("auc", "ap") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def stacking(df: DataFrame, kinds: Sequence[str], features: Sequence[str], fold: str, k: int, label: str = "label") -> tuple[DataFrame, PipelineModel]:
    """Out-of-fold scores of several families as inputs of a logistic model: (scored rows, final model)."""
    d = df
    for kind in kinds:
        d = out_of_fold(d, kind, features, fold, k, label).withColumnRenamed("oof", f"oof_{kind}")
    names = [f"oof_{x}" for x in kinds]
    model = estimator("logistic", names, label).fit(class_weight(d, label))
    return score(model, d, "stacked"), model


def trials(seed: int, n: int = 28) -> list[dict]:
    """The anchors and n random draws."""
    rng = random.Random(seed)
    return [*ANCHORS, *[{k: rng.choice(v) for k, v in SEARCH.items()} for _ in range(n)]]


def search(train: DataFrame, valid: DataFrame, features: Sequence[str], candidates: Sequence[dict], label: str = "label", threads: int = 2, fit: Callable | None = None) -> list[dict]:
    """Trials run side by side, best first by (F1, average precision, recall, precision, fewer trees)."""
    total = valid.filter(F.col(label) == 1).count()
    train = class_weight(train, label)

    def one(params: dict) -> dict:
        model = (fit or (lambda p: estimator("gbt", features, label, **p).fit(train)))(params)
        s = score(model, valid)
        best = best_prefix(s, "score", label, total).first()
        ap = auc_ap(s, "score", label).first()
        return {"params": params, "threshold": best["threshold"], "f1": best["f1"], "precision": best["precision"], "recall": best["recall"], "ap": ap["ap"]}

    with ThreadPoolExecutor(threads) as pool:
        done = list(pool.map(one, candidates))
    return sorted(done, key=lambda r: (-r["f1"], -r["ap"], -r["recall"], -r["precision"], r["params"].get("maxIter", 0)))


def gaussian_mixture(df: DataFrame, features: Sequence[str], label: str | None = None, seed: int = 42) -> DataFrame:
    """`df` with `gmm`: probability of the component that holds more of the label mass (without a label, of the higher mean)."""
    va = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")
    sc = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
    model = Pipeline(stages=[va, sc, GaussianMixture(k=2, featuresCol="_x", seed=seed)]).fit(df)
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    by = F.col(label).cast("double") if label else sum((F.col(f) for f in features[1:]), F.col(features[0]))
    m = out.agg((F.sum(F.col("_p")[0] * by) / F.sum(F.col("_p")[0])).alias("a"), (F.sum(F.col("_p")[1] * by) / F.sum(F.col("_p")[1])).alias("b")).first()
    which = 0 if (m["a"] or 0) >= (m["b"] or 0) else 1
    return out.withColumn("gmm", F.col("_p")[which]).drop("_raw", "_x", "_p", "probability", "prediction")


def soft_ensemble(df: DataFrame, key: Sequence[str], members: Sequence[str], label: str = "label", most: int = 5) -> DataFrame:
    """`df` with `ensemble`: mean of the members' percent ranks, weighted by average precision, of the best `most`. `key` is unique."""
    from brindle.operators.ranking import pct_ranks

    ap = {m: auc_ap(df, m, label).first()["ap"] for m in members}
    best = sorted(members, key=lambda m: -ap[m])[:most]
    ranked = pct_ranks(df.select(*key, *best), key, best, "_r_")
    total = sum(ap[m] for m in best) or 1.0
    mix = sum((F.col(f"_r_{m}") * (ap[m] / total) for m in best[1:]), F.col(f"_r_{best[0]}") * (ap[best[0]] / total))
    return df.join(ranked, list(key)).withColumn("ensemble", mix).drop(*[f"_r_{m}" for m in best])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
