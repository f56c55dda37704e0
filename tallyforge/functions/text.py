"""Text expressions shared by the operators; all of them are built-in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}]+"
NOT_WORD = r"[^\p{L}\p{Nd}]+"
REFERENCE_TAG = r"(?<![\p{L}\p{Nd}])ref[^\p{L}\p{Nd}]*tbv\d+[^\p{L}\p{Nd}]*h?\d+"


def words(text: Column) -> Column:
    """Maximal runs of letters or digits in lower case; null gives an empty list."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def squeezed(text: Column) -> Column:
    """Letters and digits alone, in lower case; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(text), NOT_WORD, ""), F.lit(""))


def content_line(text: Column) -> Column:
    """Sorted distinct words of a signal line without its reference tag, joined by blanks."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), REFERENCE_TAG, " ")
    spaced = F.trim(F.regexp_replace(bare, NOT_WORD, " "))
    return F.array_join(F.sort_array(F.array_distinct(F.split(spaced, " "))), " ")
