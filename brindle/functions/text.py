"""String functions as Column expressions: tokens, n-grams, set similarities, overlaps of word sequences.

All of them stay in the JVM. Inputs named `norm` are already normalized (see normal.py).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = "CAST(array() AS array<string>)"


def words(norm: Column) -> Column:
    """Words of a normalized text, in order; an empty array for '' or null."""
    return F.coalesce(F.filter(F.split(norm, " "), lambda w: w != ""), F.expr(_EMPTY))


def white_words(c: Column) -> Column:
    """Lower-case words split at white space."""
    return F.coalesce(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""), F.expr(_EMPTY))


def ascii_tokens(c: Column) -> Column:
    """Distinct runs of [a-z0-9] of the lower-cased text; other letters separate."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), F.expr(_EMPTY)))


def digit_set(c: Column) -> Column:
    """Distinct runs of digits."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0)), F.expr(_EMPTY)))


def _windows(size: Column, n: int, piece) -> Column:
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), piece)).otherwise(F.expr(_EMPTY))


def char_ngrams(norm: Column, n: int) -> Column:
    """Character n-grams with blanks removed, with repetitions; none for shorter texts."""
    s = F.replace(F.coalesce(norm, F.lit("")), F.lit(" "), F.lit(""))
    return _windows(F.length(s), n, lambda i: F.substring(s, i, F.lit(n)))


def char_ngram_set(norm: Column, n: int) -> Column:
    """Distinct character n-grams with '_' for a blank."""
    s = F.replace(F.coalesce(norm, F.lit("")), F.lit(" "), F.lit("_"))
    return F.array_distinct(_windows(F.length(s), n, lambda i: F.substring(s, i, F.lit(n))))


def word_ngrams(w: Column, n: int) -> Column:
    """n-grams of an array of words, joined by a blank, with repetitions."""
    return _windows(F.size(w), n, lambda i: F.array_join(F.slice(w, i, n), " "))


def word_ngram_set(w: Column, n: int) -> Column:
    return F.array_distinct(word_ngrams(w, n))


def char_wb_ngrams(w: Column, low: int, high: int) -> Column:
    """Character n-grams inside words padded with one blank at each side, low <= n <= high, with
    repetitions; none of a padded word shorter than n."""

    def of(word: Column) -> Column:
        s = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*[_windows(F.length(s), n, _cut(s, n)) for n in range(low, high + 1)])

    return F.flatten(F.transform(w, of))


def _cut(s: Column, n: int):
    return lambda i: F.substring(s, i, F.lit(n))


def _sizes(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard of two arrays as sets; `empty` where both are."""
    i, n, m = _sizes(a, b)
    return F.when((n == 0) & (m == 0), F.lit(empty)).otherwise(i / (n + m - i).cast("double"))


def dice(a: Column, b: Column, empty: float = 0.0) -> Column:
    i, n, m = _sizes(a, b)
    return F.when((n == 0) & (m == 0), F.lit(empty)).otherwise(2.0 * i / (n + m))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient; 0 where a side is empty."""
    i, n, m = _sizes(a, b)
    return F.when((n == 0) | (m == 0), F.lit(0.0)).otherwise(i / F.least(n, m).cast("double"))


def _count(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y == x)).cast("double")


def cosine_counts(a: Column, b: Column) -> Column:
    """Cosine of the count vectors of two arrays; 1 where both are empty, 0 where one is."""
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, x: s + _count(a, x) * _count(b, x))
    norm = lambda v: F.sqrt(F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, x: s + _count(v, x) * _count(v, x)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def common_prefix_len(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))).otherwise(F.lit(0))


def common_suffix_len(a: Column, b: Column) -> Column:
    return common_prefix_len(F.reverse(a), F.reverse(b))


def acronym(norm: Column) -> Column:
    """First letters of the words."""
    return F.array_join(F.transform(words(norm), lambda w: F.substring(w, 1, 1)), "")


def contains_nonempty(a: Column, b: Column) -> Column:
    """1.0 where a is not empty and occurs in b."""
    return F.when((a != "") & F.contains(b, a), F.lit(1.0)).otherwise(F.lit(0.0))


def prf(hits: Column, n_candidate: Column, n_reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is."""
    p = F.when(n_candidate > 0, hits / n_candidate.cast("double")).otherwise(F.lit(0.0))
    r = F.when(n_reference > 0, hits / n_reference.cast("double")).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return p, r, f


def rouge_n(reference: Column, candidate: Column, n: int) -> tuple[Column, Column, Column]:
    """ROUGE-n (precision, recall, F1) over sets of word n-grams."""
    a, b = word_ngram_set(white_words(reference), n), word_ngram_set(white_words(candidate), n)
    return prf(F.size(F.array_intersect(a, b)), F.size(b), F.size(a))


def text_set(values: Column, limit: int = 0) -> Column:
    """Distinct non-empty normalized values, first seen first, at most `limit`. `values` is normalized already."""
    v = F.array_distinct(F.filter(F.coalesce(values, F.expr(_EMPTY)), lambda x: x.isNotNull() & (x != "")))
    return F.slice(v, 1, limit) if limit else v


def token_set(values: Column) -> Column:
    """Distinct words of an array of normalized values."""
    return F.array_distinct(F.flatten(F.transform(values, words)))


def compare_text_sets(a: Column, b: Column, prefix: str) -> dict[str, Column]:
    """Five comparisons of two arrays of normalized values."""
    ta, tb = token_set(a), token_set(b)
    return {
        f"{prefix}_exact_count": F.size(F.array_intersect(a, b)).cast("double"),
        f"{prefix}_value_jaccard": jaccard(a, b),
        f"{prefix}_token_jaccard": jaccard(ta, tb),
        f"{prefix}_token_dice": dice(ta, tb),
        f"{prefix}_token_overlap": overlap(ta, tb),
    }


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def parse_numbers(c: Column, kind: str = "int") -> Column:
    """An array from a comma-separated list; entries that are no number are dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast(kind)), lambda x: x.isNotNull())


def iri_label(iri: Column) -> Column:
    """A readable label from the last part of an identifier: camel case split, underscores to blanks."""
    local = F.regexp_extract(iri, r"([^#/]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(local, "([a-z])([A-Z])", "$1 $2"), "_", " "))


def local_name(iri: Column) -> Column:
    """The last part of an identifier, lower case, other characters as single underscores; 'unknown' for none."""
    local = F.regexp_replace(F.regexp_replace(F.regexp_extract(iri, r"([^#/]*)$", 1), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(local, F.lit("")) == "", F.lit("unknown")).otherwise(F.lower(local))


#: Parts of a tag's name that give its role, in order of precedence.
TAG_ROLES = {
    "definition": ("definition", "description", "scope_note", "iao_0000115", "p97"),
    "synonym": ("synonym", "altlabel", "full_syn", "p90"),
    "label": ("label", "pref", "p108"),
    "xref": ("xref", "code", "identifier", "database", "hasdb"),
}


def tag_role(tag: Column) -> Column:
    """definition, synonym, label, xref or other; the first role with a part in the tag's name."""
    low, out = F.lower(tag), None
    for role, parts in TAG_ROLES.items():
        cond = low.rlike("|".join(parts))
        out = F.when(cond, F.lit(role)) if out is None else out.when(cond, F.lit(role))
    return out.otherwise(F.lit("other"))
