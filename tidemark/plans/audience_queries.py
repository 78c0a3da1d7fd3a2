"""Registered audience queries over the role views."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions import predicates as p
from tidemark.operators import audience as op
from tidemark.operators import ordering
from tidemark.plans import audience as plan
from tidemark.plans.specs import AudienceSpec, LookBack
from tidemark.sources import catalog, roles, tables

RUN_DATE = roles.RUN_DATE
MOST_COUNTRIES = ",".join(f"NATION_{n}" for n in range(1, 25) if n not in (7, 9, 13))
COUNTRIES = "NATION_10,NATION_12,NATION_3,NATION_21,NATION_17,NATION_5"

SPECS = {
    "audience_filters": AudienceSpec(
        kind="broadcast- one time", locale="EN", l90=(">=", 1), minimum_version=5.1, device_type="ios",
        age=(15, 60), creator_tier="Elementary+", subscriber=False, country_text=MOST_COUNTRIES,
        region_text="Africa,ASIA,europe",
    ),
    "audience_not_english": AudienceSpec(locale="not EN", creator_tier="Beginner", subscriber=True),
    "audience_activity": AudienceSpec(l7=("<", 2), l90=(">", 0)),
    "audience_country_in": AudienceSpec(country_single="All"),
    "audience_country_list": AudienceSpec(kind="email", country_multiple=("NATION_3", "NATION_8", "NATION_12")),
    "audience_locale_prefix": AudienceSpec(locale_prefix="fr"),
    "audience_email_verified_split": AudienceSpec(kind="email", hash_split=True),
    "audience_opened_window": AudienceSpec(kind="email", opened=LookBack(3, 1)),
    "audience_not_bounced": AudienceSpec(kind="email", bounced_days=1),
    "audience_members": AudienceSpec(member=True),
    "audience_non_members": AudienceSpec(member=False),
    "audience_excluded": AudienceSpec(exclude_listed=True),
    "audience_usage_min": AudienceSpec(usage_min_days=8),
    "audience_pushed_not_viewed": AudienceSpec(exclude_pushed_not_viewed=True),
    "audience_full": AudienceSpec(
        kind="email", locale="EN", l90=(">=", 0), minimum_version=1.0, age=(13, 70), creator_tier="Beginner+",
        country_text=MOST_COUNTRIES,
        region_text="AFRICA,AMERICA,ASIA,EUROPE", opened=LookBack(20, 0), clicked=LookBack(27, 0), bounced_days=1,
        exclude_listed=False, exclude_pushed_not_viewed=True, usage_min_days=2, hash_split=True,
    ),
}


class RoleTables(dict):
    """Role views made when first asked for, so a filter that is off reads nothing."""

    def __init__(self, spark, sf_dir):
        super().__init__()
        self._source = (spark, sf_dir)

    def __missing__(self, name):
        self[name] = getattr(roles, name)(*self._source)
        return self[name]


def role_tables(spark, sf_dir):
    return RoleTables(spark, sf_dir)


def _built(name, spark, sf_dir):
    return plan.build(SPECS[name], role_tables(spark, sf_dir), RUN_DATE, roles.PAGE_CLICK_RULES)


def clicked_union(spark, sf_dir):
    """Cohort users who clicked in a mail or on a classified link."""
    clicked = op.clickers(
        roles.email_click(spark, sf_dir), roles.deep_link(spark, sf_dir), RUN_DATE, LookBack(2, 0),
        roles.PAGE_CLICK_RULES,
    )
    return op.keep(op.users(roles.cohort(spark, sf_dir)), clicked)


def link_labels(spark, sf_dir):
    """Classified link visits by label and day code."""
    visits = op.link_days(roles.deep_link(spark, sf_dir), roles.PAGE_CLICK_RULES)
    return visits.groupBy("label", dates.day_code(F.col("ds"), short=True).alias("day_code")).agg(
        F.count("*").alias("visits")
    )


def bounced_two_years(spark, sf_dir):
    return op.bouncers_of_years(roles.email_touch(spark, sf_dir), RUN_DATE)


def region_attribute(spark, sf_dir):
    rows = op.with_region(
        tables.on_day(roles.cohort(spark, sf_dir), RUN_DATE), roles.region_dim(spark, sf_dir), RUN_DATE
    )
    return rows.groupBy("region").agg(F.count("*").alias("users"))


def country_exact(spark, sf_dir):
    """Exact country codes next to the text match, which also lets in parts of longer codes."""
    rows = tables.on_day(roles.cohort(spark, sf_dir), RUN_DATE)
    return rows.groupBy("country").agg(
        F.count(F.when(p.code_in_text(COUNTRIES, F.col("country")), 1)).alias("by_text"),
        F.count(F.when(F.col("country").isin(COUNTRIES.split(",")), 1)).alias("by_code"),
    )


def audience_count(spark, sf_dir):
    return tables.row_count(_built("audience_filters", spark, sf_dir))


def _two_days(spark, sf_dir):
    role = role_tables(spark, sf_dir)
    spec = AudienceSpec(kind="email", locale="EN", hash_split=True)
    days = []
    for run_date in ("2024-01-27", RUN_DATE):
        identity = role["identity"].withColumn("ds", dates.day(run_date))
        built = plan.build(spec, {"cohort": role["cohort"], "identity": identity}, run_date)
        days.append(built.withColumn("ds", dates.day(run_date)))
    return days[0].unionByName(days[1])


def audience_view(spark, sf_dir):
    """The view over a dated audience shows the run date's users."""
    return plan.current(_two_days(spark, sf_dir), RUN_DATE)


def audience_view_all_days(spark, sf_dir):
    return plan.current(_two_days(spark, sf_dir), RUN_DATE, all_days=True, arm="treatment")


STORED = (
    "cohort", "identity", "activity", "feature_usage", "region_dim", "email_touch", "email_click", "deep_link",
    "push_lookback",
)


def _name(kind):
    return f"tidemark_{uuid.uuid4().hex[:8]}_{kind}"


def full_stored(spark, sf_dir):
    """The full audience from catalog tables bucketed by user, with a partition per day where a role has days."""
    prefix, role = _name("role"), role_tables(spark, sf_dir)
    made = catalog.stored(spark, {n: partial(role.__getitem__, n) for n in STORED}, prefix, op.USER, buckets=4)
    found = ordering.settle(plan.build(SPECS["audience_full"], made, RUN_DATE, roles.PAGE_CLICK_RULES))
    for name in STORED:
        catalog.drop(spark, f"{prefix}_{name}")
    return found


def replaced(spark, sf_dir):
    """A catalog table while it is replaced: its users after a replacement that fails half way, and after one that works."""
    name = _name("audience")
    catalog.replace(_built("audience_not_english", spark, sf_dir), name)
    after = _built("audience_locale_prefix", spark, sf_dir)
    broken = after.withColumn(op.USER, F.when(F.hash(op.USER) % 3 == 0, F.raise_error(F.lit("stopped"))).otherwise(F.col(op.USER)))
    try:
        catalog.replace(broken, name)
    except Exception as error:  # the error raised above comes back in the engine's own wrapping
        if "stopped" not in str(error):
            raise
    old = ordering.settle(spark.table(name).select(F.lit("failed").alias("step"), op.USER))
    catalog.replace(after, name)
    new = ordering.settle(spark.table(name).select(F.lit("replaced").alias("step"), op.USER))
    catalog.drop(spark, name)
    return old.unionByName(new)


def run_date_view(spark, sf_dir):
    """A view in the catalog that follows a table of run dates: the partition is found when the query runs."""
    table, run_dates, view = _name("audience"), _name("run_dates"), _name("current")
    catalog.replace(_two_days(spark, sf_dir), table, dated=True)
    day = spark.range(1).select(F.lit("audience").alias("job"), dates.day(RUN_DATE).alias(tables.DAY))
    catalog.replace(day, run_dates)
    plan.lasting_view(spark, view, table, run_dates)
    found = ordering.settle(spark.table(view))
    spark.sql(f"DROP VIEW {view}")
    for name in (table, run_dates):
        catalog.drop(spark, name)
    return found


QUERIES = {
    **{name: partial(_built, name) for name in SPECS},
    "audience_clicked_union": clicked_union,
    "audience_link_labels": link_labels,
    "audience_bounced_two_years": bounced_two_years,
    "audience_region_attribute": region_attribute,
    "audience_country_match": country_exact,
    "audience_count": audience_count,
    "audience_view": audience_view,
    "audience_view_all_days": audience_view_all_days,
    "audience_full_stored": full_stored,
    "audience_replaced": replaced,
    "audience_run_date_view": run_date_view,
}
