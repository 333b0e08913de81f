"""What several operators here share: identifiers as the profiles write them, clean scores, hot groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefixes of compact identifiers and the namespaces they stand for.
CURIE_PREFIXES = {
    "AV": "http://avelon.example/ont#AV_",
    "MB": "http://morbex.example/obo/MB_",
    "MBL": "http://morbex.example/legacy#MB_",
}


def canonical_iri(c: Column) -> Column:
    """An identifier as the profiles write it: no blanks or brackets around it, plain http, lower-case host
    without www, '#' not escaped, compact forms expanded. Null and blank give null; unknown forms stay."""
    x = F.regexp_replace(c, r"^[\s<]+|[\s>]+$", "")
    x = F.replace(x, F.lit("%23"), F.lit("#"))
    host = F.regexp_replace(F.lower(F.regexp_extract(x, r"^(?i:https?)://([^/]*)", 1)), r"^www\.", "")
    url = F.concat(F.lit("http://"), host, F.regexp_replace(x, r"^(?i:https?)://[^/]*", ""))
    local = F.regexp_extract(x, r"^[A-Za-z]+:(.*)$", 1)
    out = F.when(x.rlike(r"^(?i:https?)://"), url)
    for prefix, space in CURIE_PREFIXES.items():
        out = out.when(x.startswith(prefix + ":"), F.concat(F.lit(space), local))
    out = out.otherwise(x)
    # most identifiers are written so already, which one look tells
    done = c.rlike(r"^http://(?!www\.)[a-z0-9.:-]*(?:/[^%\s<>]*)?\z")
    return F.when(done, c).when(out == "", F.lit(None).cast("string")).otherwise(out)


def clean_score(c: Column) -> Column:
    """NaN becomes null; infinities stay."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(r"\S")
