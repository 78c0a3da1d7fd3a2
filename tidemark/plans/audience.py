"""Audience build: a spec and role tables in, a distinct user set out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import predicates as p
from tidemark.operators import audience as op
from tidemark.plans.specs import AudienceSpec, tiers_for
from tidemark.sources import catalog, tables

Rules = Sequence[tuple[str, str, str]]


def cohort_filter(spec: AudienceSpec):
    """Conjunction of the filters on the cohort's own columns."""
    tests = []
    if spec.locale != fixed.NOT_REQUIRED:
        tests.append(p.locale_is_english(F.col("locale"), spec.locale == "EN"))
    if spec.locale_prefix:
        tests.append(p.locale_starts_with(F.col("locale"), spec.locale_prefix))
    if spec.creator_tier != fixed.NOT_REQUIRED:
        tests.append(F.col("creator_tier").isin(tiers_for(spec.creator_tier)))
    if spec.subscriber is not None:
        tests.append(F.col("is_subscriber") == F.lit(spec.subscriber))
    if spec.country_text is not None:
        tests.append(p.code_in_text(spec.country_text, F.col("country")))
    if spec.country_multiple:
        tests.append(F.col("country").isin(list(spec.country_multiple)))
    elif spec.country_single and spec.country_single != "All":
        tests.append(F.col("country") == spec.country_single)
    return _all(tests)


def identity_filter(spec: AudienceSpec):
    tests = []
    if spec.kind == "email":
        tests.append(F.col("is_email_verified"))
    if spec.minimum_version is not None:
        tests.append(p.version_at_least(F.col("version"), spec.minimum_version))
    if spec.device_type != fixed.NOT_REQUIRED:
        tests.append(p.same_text(F.col("device_type"), spec.device_type))
    if spec.age:
        tests.append(F.col("age").between(*spec.age))
    return _all(tests)


def activity_filter(spec: AudienceSpec):
    tests = []
    if spec.l7:
        tests.append(p.compare(F.col("l_7"), *spec.l7))
    if spec.l90:
        tests.append(p.compare(F.col("l_90"), *spec.l90))
    return _all(tests)


def _all(tests):
    joined = F.lit(True)
    for test in tests:
        joined = joined & test
    return joined


def build(
    spec: AudienceSpec,
    role: Mapping[str, DataFrame],
    run_date,
    rules: Rules = (),
) -> DataFrame:
    """Distinct users that pass every filter that is switched on.

    All list filters run on the internal id; ids are mapped last, so an
    exclusion list always meets the id it is written in.
    """
    found = tables.on_day(role["cohort"], run_date).where(cohort_filter(spec))
    if spec.country_single == "All":
        found = op.in_named_countries(found, role["country_map"])
    found = found.select(op.USER)
    if spec.needs_identity:
        today = tables.on_day(role["identity"], run_date)
        found = op.keep(found, op.users(today, identity_filter(spec)))
    if spec.needs_activity:
        today = tables.on_day(role["activity"], run_date)
        found = op.keep(found, op.users(today, activity_filter(spec)))
    if spec.usage_min_days is not None:
        found = op.keep(found, op.frequent_users(role["feature_usage"], run_date, spec.usage_min_days))
    if spec.region_text is not None:
        found = op.keep(found, op.users_of_region(role["region_dim"], run_date, spec.region_text))
    if spec.opened and spec.bounced_days is not None:
        listed = op.openers_without_bounce(role["email_touch"], run_date, spec.opened, spec.bounced_days)
        found = op.keep(found, listed)
    elif spec.opened:
        found = op.keep(found, op.openers(role["email_touch"], run_date, spec.opened))
    if spec.clicked:
        clicked = op.clickers(role["email_click"], role["deep_link"], run_date, spec.clicked, rules)
        found = op.keep(found, clicked)
    if spec.member is not None:
        listed = op.users(tables.on_day(role["members"], run_date))
        found = op.keep(found, listed) if spec.member else op.drop(found, listed)
    if spec.bounced_days is not None and not spec.opened:
        found = op.drop(found, op.bouncers(role["email_touch"], run_date, spec.bounced_days))
    if spec.exclude_listed:
        found = op.drop(found, op.users(role["exclusion"]))
    if spec.exclude_pushed_not_viewed:
        found = op.drop(found, op.pushed_not_viewed(role["push_lookback"]))
    found = found.distinct()
    if spec.kind != "email":
        found = op.mapped_users(found, role["id_map"])
    if spec.hash_split:
        found = found.withColumn("group_assignment", p.hash_arm(F.col(op.USER)))
    return found


def write(audience: DataFrame, spec: AudienceSpec, path: str, run_date) -> None:
    """Create or replace the audience table: that day's part when dated, all of it otherwise."""
    if spec.dated:
        tables.replace_days(audience.withColumn(tables.DAY, F.lit(str(run_date)).cast("date")), path)
    else:
        tables.replace_table(audience, path)


def current(stored: DataFrame, run_date, all_days: bool = False, arm: str | None = None) -> DataFrame:
    """View of a dated audience: users of the run date, or of every day; optionally one arm."""
    rows = stored if all_days else tables.on_day(stored, run_date)
    if arm is not None:
        rows = rows.where(F.col("group_assignment") == arm)
    return rows.select(op.USER).distinct()


def register_view(stored: DataFrame, name: str, run_date, **options) -> None:
    current(stored, run_date, **options).createOrReplaceTempView(name)


def lasting_view(spark: SparkSession, name: str, table: str, run_dates: str | None = None, job: str = "audience") -> None:
    """A view in the catalog over a dated audience table: users of every day, or of the day that run_dates holds."""
    day = f"{tables.DAY} IN (SELECT {tables.DAY} FROM {run_dates} WHERE job = '{job}')" if run_dates else None
    catalog.view(spark, name, table, [op.USER], day)
