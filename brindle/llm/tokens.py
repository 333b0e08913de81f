"""Token counts of the public WordPunct tokenizer.

Maximal runs of word characters and maximal runs of characters that are neither word characters nor
white space, as Python's `re` sees them: letters, numbers and the underscore are word characters,
combining marks are not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
PATTERN = rf"[{_WORD}]+|[^{_WORD}{_SPACE}]+"


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for a null or blank text."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("bigint")
