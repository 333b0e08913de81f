"""Text normal forms.

The camel-aware normal form: compatibility decomposition, combining marks removed, a blank between a
lower-case letter or digit and a following capital, lower case, runs of [a-z0-9] joined by one blank.
ASCII values stay in JVM expressions; only values with other characters visit Python.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_CAMEL = re.compile(r"[A-Z](?<=[a-z0-9][A-Z])")  # led by the capital, so that the search skips to capitals
_RUNS = re.compile(r"[a-z0-9]+")


def strip_accents_py(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def normal_words_py(s: str) -> list[str]:
    """The words of the normal form of one value."""
    if not s.isascii():
        s = strip_accents_py(s)
    if not s.islower():
        s = _CAMEL.sub(r" \g<0>", s).lower()
    return _RUNS.findall(s)


def normal_form_py(s: str | None) -> str | None:
    """The normal form of one value; None stays None."""
    return None if s is None else " ".join(normal_words_py(s))


@F.pandas_udf(StringType())
def _normal_udf(s: pd.Series) -> pd.Series:
    return s.map(normal_form_py, na_action="ignore")


@F.pandas_udf(StringType())
def _strip_udf(s: pd.Series) -> pd.Series:
    return s.map(strip_accents_py, na_action="ignore")


def _is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def strip_accents(c: Column) -> Column:
    """Decomposed (NFKD) without combining marks; null stays null."""
    return F.when(_is_ascii(c), c).otherwise(_strip_udf(F.when(_is_ascii(c), F.lit(None).cast("string")).otherwise(c)))


def form_ascii(c: Column) -> Column:
    """The normal form of an ASCII value. Values that are in it already, as most are, skip the replacements."""
    spaced = F.when(c.rlike("[a-z0-9][A-Z]"), F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")).otherwise(c)
    return F.when(c.rlike(r"^[a-z0-9]+(?: [a-z0-9]+)*\z"), c).otherwise(F.trim(F.regexp_replace(F.lower(spaced), r"[^a-z0-9]+", " ")))


def words_ascii(c: Column) -> Column:
    """The words of an ASCII value's normal form, in order."""
    return _split(form_ascii(c))


def _split(form: Column) -> Column:
    return F.when(form == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split(form, " "))


def normal_words(c: Column) -> Column:
    """Words of the camel-aware normal form as an array; null for null."""
    return _split(normal_form(c))


def normal_form(c: Column) -> Column:
    """The camel-aware normal form; null for null, '' where nothing is left."""
    other = _normal_udf(F.when(_is_ascii(c), F.lit(None).cast("string")).otherwise(c))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(_is_ascii(c), form_ascii(c)).otherwise(other)


@F.pandas_udf(ArrayType(StringType()))
def _normal_arrays_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else [normal_form_py(v) for v in x])


def normal_forms(c: Column) -> Column:
    """The normal form of every element of an array; null elements and null arrays stay null. Arrays of ASCII
    values stay in JVM expressions."""
    ascii_ = _is_ascii(F.array_join(c, " "))
    other = _normal_arrays_udf(F.when(~ascii_, c))
    return F.when(ascii_, F.transform(c, form_ascii)).otherwise(other)


def normalize_text(c: Column) -> Column:
    """Accents stripped, lower case, every other run of characters one blank, trimmed. Null gives ''."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"[^0-9a-z]+", " "))
