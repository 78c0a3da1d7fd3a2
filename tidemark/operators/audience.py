"""Audience filters as semi- and anti-joins on the user key.

Each right side is cut to its own predicates and to one row per user before the
join: repeated users collapse map-side, nothing fans out, and all joins share
one partitioning by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions import predicates as p
from tidemark.plans.specs import LookBack
from tidemark.sources import tables

USER = "user_id"


_OPENS = ("campaign_open", "transactional_open")


def users(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Distinct users of the rows that meet the condition."""
    kept = df if condition is None else df.where(condition)
    return kept.select(USER).distinct()


def keep(audience: DataFrame, listed: DataFrame) -> DataFrame:
    return audience.join(listed, USER, "left_semi")


def drop(audience: DataFrame, listed: DataFrame) -> DataFrame:
    return audience.join(listed, USER, "left_anti")


def _window(df: DataFrame, run_date, days: LookBack) -> DataFrame:
    return tables.between_days(df, *dates.look_back(run_date, days.upper, days.lower))


def openers(touches: DataFrame, run_date, days: LookBack) -> DataFrame:
    opened = p.any_positive(*map(F.col, _OPENS))
    return users(_window(touches, run_date, days), opened)


def bouncers(touches: DataFrame, run_date, days: int) -> DataFrame:
    """Users with a bounce or an unsubscribe in the last days."""
    return users(_window(touches, run_date, LookBack(days)), _bounced())


def openers_without_bounce(touches: DataFrame, run_date, opened: LookBack, bounced_days: int) -> DataFrame:
    """Openers of their window who did not bounce in theirs, from one scan over both windows."""
    spans = {
        "_opened": (dates.look_back(run_date, opened.upper, opened.lower), p.any_positive(*map(F.col, _OPENS))),
        "_bounced": (dates.look_back(run_date, bounced_days, 0), _bounced()),
    }
    first = F.least(*[low for (low, _), _ in spans.values()])
    last = F.greatest(*[high for (_, high), _ in spans.values()])
    flags = [F.max(F.col(tables.DAY).between(*days) & seen).alias(name) for name, (days, seen) in spans.items()]
    found = tables.between_days(touches, first, last).groupBy(USER).agg(*flags)
    return found.where(F.col("_opened") & ~F.col("_bounced")).select(USER)


def bouncers_of_years(touches: DataFrame, run_date, years: int = 2) -> DataFrame:
    """The long look-back: from that many years before today to the run date."""
    run = dates.day(run_date)
    start = dates.years_before(F.date_add(run, dates.RUN_LAG_DAYS), years)
    return users(tables.between_days(touches, start, run), _bounced())


def _bounced() -> Column:
    return p.any_positive(
        F.col("campaign_bounce"),
        F.col("campaign_unsubscribe"),
        F.col("transactional_bounce"),
        F.col("transactional_unsubscribe"),
    )


def link_days(links: DataFrame, rules) -> DataFrame:
    """Classified link visits, one row per user, day and label."""
    labelled = links.withColumn("label", p.click_label(rules)).where(F.col("label").isNotNull())
    return labelled.select(USER, tables.DAY, "label").distinct()


def click_days(clicks: DataFrame, links: DataFrame, rules) -> DataFrame:
    """User and day of email clicks and of classified link visits, each source without repeats."""
    clicked = p.any_positive(F.col("campaign_click"), F.col("transactional_click"))
    mails = clicks.where(clicked).select(USER, tables.DAY).distinct()
    visits = links.where(p.click_label(rules).isNotNull()).select(USER, tables.DAY).distinct()
    return mails.unionByName(visits)


def clickers(clicks: DataFrame, links: DataFrame, run_date, days: LookBack, rules) -> DataFrame:
    return users(_window(click_days(clicks, links, rules), run_date, days))


def frequent_users(usage: DataFrame, run_date, least_days: int) -> DataFrame:
    return users(tables.on_day(usage, run_date), F.col("active_days_l30") >= least_days)


def pushed_not_viewed(pushes: DataFrame, least_pushes: int = 5) -> DataFrame:
    """Users pushed often enough who viewed nothing; missing view counts are zero."""
    nothing = F.lit(True)
    for viewed in ("viewed_30d", "chat_viewed_30d"):
        nothing = nothing & (F.coalesce(F.col(viewed), F.lit(0)) == 0)
    return users(pushes, (F.col("push_success_30d") >= least_pushes) & nothing)


def users_of_region(regions: DataFrame, run_date, region_text: str) -> DataFrame:
    matches = p.code_in_text(region_text, F.col("region"), ignore_case=True)
    return users(tables.on_day(regions, run_date), matches)


def with_region(audience: DataFrame, regions: DataFrame, run_date) -> DataFrame:
    """Region as an attribute: the day is tested on the right side only, users without one stay."""
    today = tables.on_day(regions, run_date).groupBy(USER).agg(F.max("region").alias("region"))
    return audience.join(today, USER, "left")


def named_countries(country_map: DataFrame) -> DataFrame:
    named = (F.col("name") != "") & ~F.upper(F.col("name")).like("UNKNOWN%")
    return country_map.where(named).select("country").distinct()


def in_named_countries(cohort: DataFrame, country_map: DataFrame) -> DataFrame:
    return cohort.join(named_countries(country_map), "country", "left_semi")


def mapped_users(audience: DataFrame, id_map: DataFrame) -> DataFrame:
    """Outside ids of the audience; users without one fall out, users with two give both."""
    inside = id_map.withColumnRenamed(USER, "mapped_id")
    return (
        audience.join(inside, audience[USER] == inside["internal_id"])
        .select(F.col("mapped_id").alias(USER))
        .distinct()
    )
