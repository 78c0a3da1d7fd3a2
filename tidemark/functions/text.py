"""Text helpers: token case, lenient numbers and lists, file endings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed

_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"
_RUNS = rf"({_CASED}+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+)"


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    Letters after an apostrophe or a hyphen start a new run, which a plain initcap would miss.
    """
    runs = F.regexp_extract_all(text, F.lit(_RUNS), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def tokens(text: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-empty tokens."""
    parts = F.transform(F.split(text, ","), lambda t: F.trim(t))
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def joined_title_case(items: Column, sep: str = ", ") -> Column:
    """Title-case every non-blank token and join."""
    kept = F.filter(F.transform(items, lambda t: F.trim(t)), lambda t: t != "")
    return F.array_join(F.transform(kept, title_case), sep)


def lenient_double(value: Column, default: float | None = 0.0) -> Column:
    """First number found in noisy text such as '12%' or '~0.8'."""
    found = F.nullif(F.regexp_extract(value.cast("string"), fixed.LENIENT_NUMBER, 1), F.lit(""))
    return F.coalesce(found.try_cast("double"), F.lit(default).cast("double"))


def lenient_int(value: Column, default: int = 0) -> Column:
    """Whole part of a number in text; default when the text is no number."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.coalesce(number.try_cast("bigint"), F.lit(default).cast("bigint"))


def file_ending(content_type: Column) -> Column:
    """File ending for a content type; empty for neither video nor image."""
    return (
        F.when(F.contains(content_type, F.lit("video")), ".mp4")
        .when(F.contains(content_type, F.lit("jpeg")) & F.contains(content_type, F.lit("image")), ".jpg")
        .when(F.contains(content_type, F.lit("image")), ".png")
        .otherwise("")
    )


def contains_any_case(text: Column, part: str) -> Column:
    """SQL LIKE '%part%' on lower-cased text, '_' and '%' in part keeping their LIKE meaning."""
    return F.lower(text).like(f"%{part.lower()}%")
