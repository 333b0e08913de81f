"""Alignment, ranking and classifier metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import char_ngram_set, word_ngrams
from brindle.functions.text import words as split_words
from brindle.operators.ranking import best_prefix, correct_ranks
from brindle.operators.running import running


def _prf(tp: Column, n_pred: Column, n_gold: Column) -> list[Column]:
    p = F.when(n_pred > 0, tp / n_pred).otherwise(F.lit(0.0))
    r = F.when(n_gold > 0, tp / n_gold).otherwise(F.lit(0.0))
    f = F.when(tp > 0, 2.0 * tp / (n_pred + n_gold)).otherwise(F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def alignment_metrics(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of two sets of pairs. One row."""
    p, g = pred.select("src_iri", "tgt_iri").distinct().withColumn("p", F.lit(1)), gold.select("src_iri", "tgt_iri").distinct().withColumn("g", F.lit(1))
    c = p.join(g, ["src_iri", "tgt_iri"], "full_outer").agg(F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    return c.select("tp", "fp", "fn", *_prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(tp, fp, fn, tn, accuracy, precision, recall, f1) of 0/1 columns. One row; null rows are left out."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    d = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    c = d.agg(*[F.count(F.when(cond, 1)).alias(n) for n, cond in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select("tp", "fp", "fn", "tn", F.when(n > 0, (F.col("tp") + F.col("tn")) / n).otherwise(F.lit(0.0)).alias("accuracy"), *_prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))


def ranking_metrics(ranks: DataFrame, rank: str = "rank", at: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(n, n_found, mrr, hits_k ...): rank 0 or null is not found. One row."""
    r = F.coalesce(F.col(rank), F.lit(0))
    hits = [F.avg(F.when((r > 0) & (r <= k), 1.0).otherwise(0.0)).alias(f"hits_{k}") for k in at]
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(r > 0, 1)).alias("n_found"), F.avg(F.when(r > 0, 1.0 / r).otherwise(0.0)).alias("mrr"), *hits)


def _by_value(df: DataFrame, value: str, label: str, by: Sequence[str]) -> DataFrame:
    """Counts of positives and all rows by distinct value: every curve is a window over these."""
    v = F.col(value)
    d = df.filter(v.isNotNull() & ~F.isnan(v.cast("double")) & F.col(label).isNotNull())
    return d.groupBy(*by, v.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.sum((F.col(label) == 1).cast("bigint")).alias("p"))


def auc_ap(df: DataFrame, value: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, n_pos, auc, ap): area under the ROC curve (ties count half; 0.5 with one class) and average
    precision over distinct scores (0 without positives)."""
    g = _by_value(df, value, label, by)
    order = [*[F.asc_nulls_first(b) for b in by], F.asc("v")]
    g = running(g, order, sums={"upto": F.col("c"), "hits_upto": F.col("p")})
    # a row per group: where its part of the order begins, and what it holds
    whole = g.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.min(F.col("upto") - F.col("c")).alias("c0"), F.min(F.col("hits_upto") - F.col("p")).alias("p0"), F.sum("c").alias("cn"), F.sum("p").alias("pn"))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    g = g.join(F.broadcast(whole), same) if same else g.crossJoin(F.broadcast(whole))  # one row where there are no groups
    before, hits_before = F.col("upto") - F.col("c") - F.col("c0"), F.col("hits_upto") - F.col("p") - F.col("p0")
    g = g.withColumn("neg", F.col("c") - F.col("p")).withColumn("below", before - hits_before)
    g = g.withColumn("hits", F.col("pn") - hits_before).withColumn("seen", F.col("cn") - before)
    a = g.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("p").alias("n_pos"), F.sum(F.col("p") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum(F.col("p") * F.col("hits") / F.col("seen")).alias("ap_sum"))
    neg = F.col("n") - F.col("n_pos")
    return a.select(*by, "n", "n_pos", F.when((F.col("n_pos") > 0) & (neg > 0), F.col("u") / (F.col("n_pos") * neg)).otherwise(F.lit(0.5)).alias("auc"), F.when(F.col("n_pos") > 0, F.col("ap_sum") / F.col("n_pos")).otherwise(F.lit(0.0)).alias("ap"))


def feature_statistics(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """One row per feature: counts, means and medians by class, share of non-zero values, standardized mean
    difference (over the deviation of all rows), AUC and average precision."""
    base = df.select(label, *[F.col(f).cast("double").alias(f) for f in features])
    long = base.unpivot([label], list(features), "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    pos, neg = F.when(F.col(label) == 1, F.col("value")), F.when(F.col(label) == 0, F.col("value"))
    s = long.groupBy("feature").agg(F.avg(pos).alias("mean_pos"), F.avg(neg).alias("mean_neg"), F.median(pos).alias("median_pos"), F.median(neg).alias("median_neg"), F.avg(F.when(F.col("value") != 0, 1.0).otherwise(0.0)).alias("nonzero_rate"), F.stddev_pop("value").alias("std"))
    s = s.withColumn("smd", (F.col("mean_pos") - F.col("mean_neg")) / F.greatest(F.col("std"), F.lit(1e-12))).drop("std")
    return s.join(auc_ap(long, "value", label, ["feature"]), "feature")


def family_summary(stats: DataFrame, family: Column, value: str = "auc") -> DataFrame:
    """(family, n_features, best_feature, best, median)."""
    return stats.withColumn("family", family).groupBy("family").agg(F.count(F.lit(1)).alias("n_features"), F.max_by("feature", F.struct(F.col(value), F.col("feature"))).alias("best_feature"), F.max(value).alias("best"), F.median(value).alias("median"))


def signal_table(rows: DataFrame, signal: str, label: str, totals: DataFrame, least: int = 1) -> DataFrame:
    """Discrete signals: (signal, n_true, n_false, rate_true, rate_false, lift, log_odds) from rows (one per pair and
    signal) and `totals`, one row with n_true and n_false over all pairs."""
    t = totals.first()
    nt, nf = float(t["n_true"] or 0), float(t["n_false"] or 0)
    c = rows.groupBy(signal).agg(F.count(F.when(F.col(label) == 1, 1)).alias("n_true"), F.count(F.when(F.col(label) == 0, 1)).alias("n_false")).filter(F.col("n_true") + F.col("n_false") >= least)
    a, b = F.col("n_true"), F.col("n_false")
    ra, rb = a / F.lit(max(nt, 1.0)), b / F.lit(max(nf, 1.0))
    odds = F.log((a + 0.5) / (F.lit(nt) - a + 0.5)) - F.log((b + 0.5) / (F.lit(nf) - b + 0.5))
    return c.select(signal, "n_true", "n_false", ra.alias("rate_true"), rb.alias("rate_false"), (ra / F.greatest(rb, F.lit(1e-12))).alias("lift"), odds.alias("log_odds"))


def candidate_recall(cands: DataFrame, gold: DataFrame, fold: str | None = None) -> DataFrame:
    """([fold,] n_gold, n_covered, recall) with n_candidates and negatives per covered positive for the whole."""
    c = cands.select("src_iri", "tgt_iri").distinct().withColumn("c", F.lit(1))
    g = gold.select("src_iri", "tgt_iri", *([fold] if fold else [])).dropDuplicates(["src_iri", "tgt_iri"])
    j = g.join(c, ["src_iri", "tgt_iri"], "left")
    per = j.groupBy(fold) if fold else j.groupBy()
    out = per.agg(F.count(F.lit(1)).alias("n_gold"), F.count("c").alias("n_covered"))
    out = out.withColumn("recall", F.when(F.col("n_gold") > 0, F.col("n_covered") / F.col("n_gold")).otherwise(F.lit(0.0)))
    if fold:
        return out
    n = c.count()
    return out.withColumn("n_candidates", F.lit(n).cast("bigint")).withColumn("negatives_per_hit", (F.lit(n) - F.col("n_covered")) / F.greatest(F.col("n_covered"), F.lit(1)))


def shared_ngrams(pairs: DataFrame, scopes: dict[str, tuple[str, str]], words: Sequence[int] = (1, 2, 3), chars: Sequence[int] = (3, 4, 5, 6)) -> DataFrame:
    """The pairs' other columns with (scope, kind, n, gram): word and character n-grams that some text of both sides holds.

    `scopes` name the two columns of arrays of normalized texts that are compared; a null array has no texts. One row
    for each pair and gram; character n-grams have '_' for a blank.
    """
    texts = {c for ab in scopes.values() for c in ab}

    def grams(c: str, kind: str, n: int) -> Column:
        one = (lambda x: word_ngrams(split_words(x), n)) if kind == "word" else (lambda x: char_ngram_set(x, n))
        return F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce(F.col(c), F.expr("CAST(array() AS array<string>)")), lambda x: x.isNotNull()), one)))

    rows = []
    for scope, (a, b) in scopes.items():
        for kind, n in [*(("word", n) for n in words), *(("char", n) for n in chars)]:
            rows.append(F.transform(F.array_intersect(grams(a, kind, n), grams(b, kind, n)), _named(scope, kind, n)))
    return pairs.withColumn("_g", F.explode(F.concat(*rows))).select(*[c for c in pairs.columns if c not in texts], "_g.*")


def _named(scope: str, kind: str, n: int):
    return lambda g: F.struct(F.lit(scope).alias("scope"), F.lit(kind).alias("kind"), F.lit(n).alias("n"), g.alias("gram"))


def tag_presence(pairs: DataFrame, src_tags: str, tgt_tags: str) -> DataFrame:
    """The pairs' other columns with `signal`: source::TAG, target::TAG and shared::TAG, each once a pair."""
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.expr("CAST(array() AS array<string>)")), lambda x: x.isNotNull()))
    a, b = clean(src_tags), clean(tgt_tags)
    named = lambda p, arr: F.transform(arr, lambda x: F.concat(F.lit(p), x))
    signals = F.concat(named("source::", a), named("target::", b), named("shared::", F.array_intersect(a, b)))
    return pairs.withColumn("signal", F.explode(signals)).drop(src_tags, tgt_tags)


def report_rows(df: DataFrame, score: str, label: str, n: int = 500) -> DataFrame:
    """(kind, src_iri, tgt_iri, score): the n wrong pairs with the highest and the n right ones with the lowest scores, equal ones by identifiers."""
    part = lambda kind, y, order: df.filter(F.col(label) == y).orderBy(order, "src_iri", "tgt_iri").limit(n).select(F.lit(kind).alias("kind"), "src_iri", "tgt_iri", score)
    return part("deceptive_negative", 0, F.desc(score)).unionByName(part("hard_positive", 1, F.asc(score)))


def vocabulary_summary(profiles: DataFrame) -> DataFrame:
    """(n_entities, n_labels, mean_names, n_without_literals) of (iri, label, labels, literals) rows. One row."""
    names = F.size(F.array_distinct(F.filter(F.coalesce("labels", F.expr("CAST(array() AS array<string>)")), lambda x: x.isNotNull())))
    return profiles.agg(F.count(F.lit(1)).alias("n_entities"), F.count_distinct("label").alias("n_labels"), F.avg(names).alias("mean_names"), F.count(F.when(F.col("literals").isNull() | (F.size("literals") == 0), 1)).alias("n_without_literals"))


class Evaluator:
    """Named evaluations collected into one summary."""

    def __init__(self) -> None:
        self.parts: dict[str, DataFrame] = {}

    def matching(self, name: str, pred: DataFrame, gold: DataFrame) -> DataFrame:
        self.parts[name] = alignment_metrics(pred, gold)
        return self.parts[name]

    def ranking(self, name: str, scored: DataFrame, score: str, label: str) -> DataFrame:
        self.parts[name] = ranking_metrics(correct_ranks(scored, score, label))
        return self.parts[name]

    def threshold(self, name: str, scored: DataFrame, score: str, label: str, gold_total: int) -> DataFrame:
        self.parts[name] = best_prefix(scored, score, label, gold_total)
        return self.parts[name]

    def summary(self) -> DataFrame:
        """(name, metric, value) over everything evaluated."""
        out = None
        for name, df in self.parts.items():
            long = df.select([F.col(c).cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, "metric", "value").withColumn("name", F.lit(name))
            out = long if out is None else out.unionByName(long)
        return out.select("name", "metric", "value")
