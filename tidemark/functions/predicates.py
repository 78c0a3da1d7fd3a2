"""Predicates and row-level selectors. Three-valued logic is noted where it matters."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import text as tx

_OPERATORS = {
    ">=": operator.ge,
    ">": operator.gt,
    "<=": operator.le,
    "<": operator.lt,
    "=": operator.eq,
    "==": operator.eq,
    "!=": operator.ne,
    "<>": operator.ne,
}


def compare(value: Column, sign: str, bound) -> Column:
    """value <sign> bound with the sign given as text."""
    try:
        return _OPERATORS[sign.strip()](value, F.lit(bound))
    except KeyError:
        raise ValueError(f"unknown comparison sign: {sign!r}") from None


def code_in_text(codes: str, value: Column, ignore_case: bool = False) -> Column:
    """'US,CA' LIKE '%value%'.

    An empty value matches everything, NULL drops the row, and a value that is
    part of another code matches too. Use isin for exact codes.
    """
    listed = F.lit(codes)
    pattern = F.concat(F.lit("%"), value, F.lit("%"))
    if ignore_case:
        listed, pattern = F.upper(listed), F.upper(pattern)
    return F.like(listed, pattern)


def locale_starts_with(locale: Column, prefix: str) -> Column:
    return F.startswith(F.upper(locale), F.lit(prefix.upper()))


def locale_is_english(locale: Column, wanted: bool = True) -> Column:
    """NULL locale drops the row whichever way it is asked."""
    start = F.left(F.upper(locale), F.lit(2))
    return start == "EN" if wanted else start != "EN"


def version_at_least(version: Column, minimum: float) -> Column:
    """(major*100 + minor)/100 >= minimum; a missing or non-numeric part gives NULL."""
    parts = F.split(version, "[.]")
    major, minor = (F.get(parts, F.lit(i)).try_cast("int") for i in (0, 1))
    return (major * F.lit(100.0) + minor) / F.lit(100.0) >= F.lit(float(minimum))


def same_text(value: Column, wanted: str) -> Column:
    return F.upper(value) == F.lit(wanted.upper())


def any_positive(*counters: Column) -> Column:
    """True when at least one counter is above zero; NULL counts as zero."""
    found = F.lit(False)
    for counter in counters:
        found = found | (F.coalesce(counter, F.lit(0)) > 0)
    return found


def click_label(rules: Sequence[tuple[str, str, str]]) -> Column:
    """Label of the first rule (column, text, label) that matches, else NULL."""
    if not rules:
        raise ValueError("at least one click rule is needed")
    label = None
    for column, part, name in rules:
        test = tx.contains_any_case(F.col(column), part)
        label = F.when(test, name) if label is None else label.when(test, name)
    return label


def no_severe_anomaly(severity: Column) -> Column:
    """Severity list without the dropped level; a NULL list is kept."""
    return severity.isNull() | ~F.array_contains(severity, fixed.ANOMALY_SEVERITY_DROPPED)


def is_false(flag: Column) -> Column:
    """True only for FALSE: NULL is dropped."""
    return F.coalesce(~flag, F.lit(False))


def clean_traffic(spam: bool = False, house_ads: bool = True, anomalies: bool = True) -> Column:
    """Rows kept by the traffic hygiene rules that are switched on."""
    keep = F.col("optimization_goal") != fixed.GOAL_LEFT_OUT
    if spam:
        keep = keep & is_false(F.col("is_pixel_spammy"))
    if anomalies:
        keep = keep & no_severe_anomaly(F.col("app_anomaly_severity"))
    if house_ads:
        keep = keep & is_false(F.col("is_house_ad"))
    return keep


def arm_label(group_id: Column, control: str) -> Column:
    return F.when(group_id == control, "control").otherwise("treatment")


def hash_bucket(key: Column, buckets: int = 10) -> Column:
    """Stable bucket of a key from the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def hash_arm(key: Column, buckets: int = 10, treated: int = 5) -> Column:
    return F.when(hash_bucket(key, buckets) < treated, "treatment").otherwise("control")


def fast_hash_arm(key: Column, buckets: int = 10, treated: int = 5) -> Column:
    """As hash_arm with the cheaper Spark-only hash."""
    return F.when(F.pmod(F.xxhash64(key), F.lit(buckets)) < treated, "treatment").otherwise("control")


def has_text(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def _value_goal() -> Column:
    return F.col("optimization_goal").like("%_VO")


def window_conversions() -> Column:
    """Conversions in the attribution window that fits the goal and the model type.

    '_' stays a LIKE wildcard. A NULL goal or model type falls to the last branch.
    """
    goal, model = F.col("optimization_goal"), F.col("model_type")
    deep = goal.isin(fixed.APP_DEEP_FUNNEL_GOALS)
    seven_day = model.like("%7_0%")

    def pick(window: str) -> Column:
        return F.when(_value_goal(), F.col(f"conversions_value_{window}")).otherwise(
            F.col(f"conversions_{window}")
        )

    last = (
        F.when(_value_goal(), F.col("conversions_value_1_1"))
        .when(goal.like("PIXEL%"), F.col("conversions_1_1"))
        .otherwise(F.col("conversions_2_1"))
    )
    return (
        F.when(~deep & seven_day, pick("7_0"))
        .when(deep & seven_day, pick("2_0"))
        .when(deep & ~seven_day, pick("2_1"))
        .otherwise(last)
    )


def goal_prediction() -> Column:
    """Predicted value for value goals, predicted count otherwise."""
    by_value = _value_goal() | F.col("optimization_goal").like("%ROAS")
    return F.when(by_value, F.col("predicted_conversions_value")).otherwise(
        F.col("predicted_conversions")
    )


def strictly_in_band(pred: Column, conv: Column) -> Column:
    """Open band, rows without conversions are outside."""
    rate = F.try_divide(pred.cast("double"), conv.cast("double"))
    return F.coalesce((conv > 0) & (rate > fixed.SLA_LOW) & (rate < fixed.SLA_HIGH), F.lit(False))


def in_band(pred: Column, conv: Column, closed: bool = True) -> Column:
    """Prediction to outcome ratio inside the band; undefined ratios are outside."""
    rate = F.try_divide(pred.cast("double"), conv.cast("double"))
    if closed:
        inside = (rate >= fixed.SLA_LOW) & (rate <= fixed.SLA_HIGH)
    else:
        inside = (rate > fixed.SLA_LOW) & (rate < fixed.SLA_HIGH)
    return F.coalesce(inside, F.lit(False))
