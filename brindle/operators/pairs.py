"""Pair tables: labels, unions with provenance, splits, filters, scrubbing, feature assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.ranking import keep_first

KEY = ["src_iri", "tgt_iri"]


def distinct_gold(df: DataFrame) -> DataFrame:
    """Known pairs as a set of strings; rows with a null side are left out."""
    return df.select(*[F.col(k).cast("string").alias(k) for k in KEY]).filter("src_iri IS NOT NULL AND tgt_iri IS NOT NULL").distinct()


def label_pairs(pairs: DataFrame, gold: DataFrame, name: str = "label") -> DataFrame:
    """1 where the pair is known, else 0."""
    g = distinct_gold(gold).withColumn("_g", F.lit(1))
    return pairs.join(g, KEY, "left").withColumn(name, F.coalesce("_g", F.lit(0))).drop("_g")


def attach(pairs: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Value of an identifier with a default for unknown ones; `table` must hold each identifier once."""
    t = table.select(F.col("iri").alias(key), F.col(value).alias(f"{key.removesuffix('_iri')}_{value}"))
    name = f"{key.removesuffix('_iri')}_{value}"
    return pairs.join(t, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def attach_vectors(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """With src_vec and tgt_vec; unknown entities get zeros."""
    zero = F.array_repeat(F.lit(0.0), dim).cast("array<float>")
    v = lambda side: vectors.select(F.col("iri").alias(f"{side}_iri"), F.col("vec").alias(f"{side}_vec"))
    out = pairs.join(v("src"), "src_iri", "left").join(v("tgt"), "tgt_iri", "left")
    return out.withColumns({f"{s}_vec": F.coalesce(f"{s}_vec", zero) for s in ("src", "tgt")})


def union_provenance(candidates: DataFrame, graph: DataFrame, score: str = "graph06_score") -> DataFrame:
    """Full outer union of two candidate sources: from_candidates, from_graph06, from_both and the graph score (0 where absent)."""
    a = candidates.select(*KEY).distinct().withColumn("_a", F.lit(1))
    b = graph.groupBy(*KEY).agg(F.max(score).alias(score)).withColumn("_b", F.lit(1))
    j = a.join(b, KEY, "full_outer")
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return j.select(*KEY, x.cast("byte").alias("from_candidates"), y.cast("byte").alias("from_graph06"), (x & y).cast("byte").alias("from_both"), F.coalesce(score, F.lit(0.0)).alias(score))


def union_counts(union: DataFrame) -> DataFrame:
    """(only_candidates, only_graph, both, total). One row."""
    a, b = F.col("from_candidates") == 1, F.col("from_graph06") == 1
    return union.agg(F.count(F.when(a & ~b, 1)).alias("only_candidates"), F.count(F.when(b & ~a, 1)).alias("only_graph"), F.count(F.when(a & b, 1)).alias("both"), F.count(F.lit(1)).alias("total"))


def inject_gold(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Retrieved pairs and the known ones that were missed, told apart by `retrieved`."""
    r = retrieved.select(*KEY).distinct()
    missed = distinct_gold(gold).join(r, KEY, "left_anti")
    return r.withColumn("retrieved", F.lit(True)).unionByName(missed.withColumn("retrieved", F.lit(False)))


def covered(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    return distinct_gold(gold).intersect(pairs.select(*[F.col(k).cast("string").alias(k) for k in KEY]))


def missed(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    return distinct_gold(gold).subtract(pairs.select(*[F.col(k).cast("string").alias(k) for k in KEY]))


def public_view(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Train and validation pairs, each once, train preferred."""
    both = train.withColumn("split", F.lit("train")).unionByName(valid.withColumn("split", F.lit("valid")))
    return keep_first(both, KEY, [F.asc("split")])


def public_split(public: DataFrame, train: DataFrame, valid: DataFrame) -> DataFrame:
    """`public` with `split` by its source: valid where validation knows the source, else train where training does; the rest is left out."""
    v, t = valid.select("src_iri").distinct().withColumn("_v", F.lit(1)), train.select("src_iri").distinct().withColumn("_t", F.lit(1))
    j = public.join(v, "src_iri", "left").join(t, "src_iri", "left")
    return j.withColumn("split", F.when(F.col("_v") == 1, "valid").when(F.col("_t") == 1, "train")).filter("split IS NOT NULL").drop("_v", "_t")


def entity_split(ents: DataFrame, seen: DataFrame, key: str = "iri") -> DataFrame:
    """`ents` with `seen`."""
    s = seen.select(F.col(key).alias("iri")).distinct().withColumn("_s", F.lit(True))
    return ents.join(s, "iri", "left").withColumn("seen", F.coalesce("_s", F.lit(False))).drop("_s")


def hidden_pool(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of which neither side occurs in a known pair."""
    return pairs.join(known.select("src_iri").distinct(), "src_iri", "left_anti").join(known.select("tgt_iri").distinct(), "tgt_iri", "left_anti")


def valid_pool(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """Pairs of which at least one side occurs in a validation pair."""
    s, t = valid.select("src_iri").distinct().withColumn("_s", F.lit(1)), valid.select("tgt_iri").distinct().withColumn("_t", F.lit(1))
    return pairs.join(s, "src_iri", "left").join(t, "tgt_iri", "left").filter("_s = 1 OR _t = 1").drop("_s", "_t")


def needed_entities(*tables: DataFrame) -> DataFrame:
    """(iri): every identifier on either side of several pair tables."""
    out = None
    for t in tables:
        for k in KEY:
            one = t.select(F.col(k).alias("iri")).filter("iri IS NOT NULL")
            out = one if out is None else out.unionByName(one)
    return out.distinct()


def scrub(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Null, NaN and infinite numbers replaced."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return df.withColumns({c: F.when(bad(c), F.lit(value)).otherwise(F.col(c).cast("double")) for c in columns})


def impute_median(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`other` with unusable numbers replaced by the exact median of the usable ones of `train` (0 without any)."""
    good = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    m = train.agg(*[F.median(good(c)).alias(c) for c in columns]).first()
    return other.withColumns({c: F.coalesce(good(c), F.lit(float(m[c] or 0.0))) for c in columns})


def merge_shards(df: DataFrame, best: Sequence[str], least: Sequence[str]) -> DataFrame:
    """One row per pair: the highest of `best` columns, the lowest of `least` columns."""
    return df.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in best], *[F.min(c).alias(c) for c in least])


def dedupe_with_origins(df: DataFrame, origin: str = "origin", label: str = "label") -> DataFrame:
    """One row per pair: highest label, sorted distinct origins joined by '+'."""
    return df.groupBy(*KEY).agg(F.max(label).alias(label), F.array_join(F.array_sort(F.collect_set(origin)), "+").alias(origin))


def origin_flags(df: DataFrame, origins: Sequence[str], origin: str = "origin") -> DataFrame:
    parts = F.split(F.col(origin), r"\+")
    return df.withColumns({f"from_{o}": F.array_contains(parts, o).cast("int") for o in origins})


def channel_filter(mode: str) -> Column:
    """all, consensus (two origins), embed_bidir, overlap_tfidf, embed_bidir_or_consensus over from_* flags."""
    embed = (F.col("from_embed_src") == 1) & (F.col("from_embed_tgt") == 1)
    lexical = (F.col("from_overlap") == 1) & (F.col("from_tfidf") == 1)
    several = F.size(F.split("origin", r"\+")) >= 2
    return {"all": F.lit(True), "consensus": several, "embed_bidir": embed, "overlap_tfidf": lexical, "embed_bidir_or_consensus": embed | several}[mode]


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A fixed sample of n rows: the first by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def one_to_one_left_join(left: DataFrame, right: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Left join that fails where a key is repeated on either side."""
    for name, df in (("left", left), ("right", right)):
        if not df.groupBy(*key).count().filter("count > 1").isEmpty():
            raise ValueError(f"repeated keys on the {name} side")
    return left.join(right, list(key), "left")


def assemble(pairs: DataFrame, blocks: dict[str, DataFrame], arity: int | None = None) -> DataFrame:
    """Feature blocks joined by pair, columns prefixed by the block's name and two underscores; checks the number of features."""
    out = pairs.select(*KEY)
    for prefix, b in blocks.items():
        feats = [c for c in b.columns if c not in KEY]
        out = out.join(b.select(*KEY, *[F.col(c).alias(f"{prefix}__{c}" if prefix else c) for c in feats]), KEY, "left")
    n = len(out.columns) - len(KEY)
    if arity is not None and n != arity:
        raise ValueError(f"{n} features, expected {arity}")
    return out


def numeric_columns(df: DataFrame, after: str | None = None, without: str | None = None) -> list[str]:
    """Numeric columns, optionally only those after a boundary column, without those of a prefix."""
    names = df.columns
    if after is not None:
        names = names[names.index(after) + 1 :]
    kinds = dict(df.dtypes)
    return [c for c in names if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") and not (without and c.startswith(without))]


def resolve_columns(have: Sequence[str], wanted: Sequence[str], aliases: dict[str, Sequence[str]] | None = None) -> tuple[list[str], list[str]]:
    """(found, missing): wanted columns and aliases of groups in order, each once, names compared without case and underscores."""
    plain = {c.lower().replace("_", ""): c for c in have}
    found, missing = [], []
    for w in wanted:
        for one in (aliases or {}).get(w, [w]):
            c = plain.get(one.lower().replace("_", ""))
            (found if c else missing).append(c or one)
    return list(dict.fromkeys(found)), missing


def submission(matches: DataFrame) -> DataFrame:
    """(SrcEntity, TgtEntity, Relation)."""
    return matches.select(F.col("src_iri").alias("SrcEntity"), F.col("tgt_iri").alias("TgtEntity"), F.lit("=").alias("Relation"))


def validate_submission(sub: DataFrame) -> DataFrame:
    """(n, n_pairs, n_src, n_tgt, n_bad_relation, one_to_one, valid). One row."""
    if sub.columns != ["SrcEntity", "TgtEntity", "Relation"]:
        raise ValueError(f"unexpected header {sub.columns}")
    c = sub.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("SrcEntity", "TgtEntity").alias("n_pairs"), F.count_distinct("SrcEntity").alias("n_src"), F.count_distinct("TgtEntity").alias("n_tgt"), F.count(F.when(F.coalesce(F.col("Relation") != "=", F.lit(True)), 1)).alias("n_bad_relation"))
    one = (F.col("n") == F.col("n_src")) & (F.col("n") == F.col("n_tgt"))
    return c.withColumn("one_to_one", one).withColumn("valid", one & (F.col("n") == F.col("n_pairs")) & (F.col("n_bad_relation") == 0))


def blend(a: str, b: str, alpha: float) -> Column:
    return alpha * F.col(a) + (1 - alpha) * F.col(b)


def discrete_margin(group: str, score: str) -> Column:
    return F.max(score).over(Window.partitionBy(group)) - F.col(score)


def predicted_mappings(df: DataFrame, label: str = "label") -> DataFrame:
    """(src_iri, tgt_iri): the distinct pairs labelled 1; rows with a null side or label give none."""
    return df.filter((F.col(label) == 1) & F.col("src_iri").isNotNull() & F.col("tgt_iri").isNotNull()).select("src_iri", "tgt_iri").distinct()
