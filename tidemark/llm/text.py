"""Words and row keys shared by the operators, as JVM-side columns.

Fixed values: a word is a run of characters outside the ASCII characters that are neither digits nor letters; only
A-Z are lower-cased.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space of sizes: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
NOT_SIZED = r"[\x20\x09-\x0D]+"

#: Names of the columns that operators add; input columns of these names are dropped first, others pass.
ROW = ("_row_id", "_row_hash")


def lowered(text: str | Column) -> Column:
    """A-Z to a-z, nothing else; NULL counts as empty."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)


def words_of(low: str | Column) -> Column:
    """The words of a lower-cased text, in order; an empty array where there are none."""
    return F.array_remove(F.split(low, NOT_WORD), "")


def size_of(text: str | Column) -> Column:
    """The number of runs without white space; 0 for NULL."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.array_remove(F.split(whole, NOT_SIZED), "")).cast("long")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of document id and text hash, which name a row where ids repeat."""
    return left["_row_id"].eqNullSafe(right["_row_id"]) & (left["_row_hash"] == right["_row_hash"])


def row_columns(text: str = "text", key: str = "doc_id") -> list[Column]:
    return [F.col(key).alias("_row_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row_hash")]
