"""Column expressions that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text; an empty one where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def key_string(col: Column | str) -> Column:
    """A key as text; null becomes the empty text, which no number yields."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def tie_of(text: Column | str = "text") -> Column:
    """Tells apart rows that share a key, by their text."""
    return F.xxhash64(whole(text))
