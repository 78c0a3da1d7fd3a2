"""Arithmetic that stays defined: ratios over zero, half-even rounding, clipping, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double; NULL where den is zero (ANSI division would fail the job)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, and 0 where it is undefined."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def half_even(value: Column, digits: int) -> Column:
    """Round half to even, the rounding of the numeric Python stack."""
    return F.bround(value.cast("double"), digits)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def log1p(value: Column) -> Column:
    return F.log1p(value.cast("double"))


def log_shifted(value: Column, shift: float = 1e-6) -> Column:
    """Logarithm after a small shift, so that zero stays finite."""
    return F.log(value.cast("double") + F.lit(shift))


def interval_text(value: Column, low: Column, high: Column, digits: int = 3) -> Column:
    """'value (low, high)' for display; computing goes on with the numbers."""
    spec = f"%.{digits}f"
    return F.format_string(f"{spec} ({spec}, {spec})", value, low, high)


def percent_interval_text(value: Column, low: Column, high: Column) -> Column:
    hundred = F.lit(100.0)
    return F.format_string(
        "%.2f%% (%.2f%%, %.2f%%)", value * hundred, low * hundred, high * hundred
    )


def percent_text(value: Column) -> Column:
    return F.format_string("%.2f%%", value * F.lit(100.0))


def percent_value(text: Column) -> Column:
    """'1.25%' back to 0.0125; NULL when it is no number."""
    return F.rtrim(F.trim(text), F.lit("%")).try_cast("double") / F.lit(100.0)
