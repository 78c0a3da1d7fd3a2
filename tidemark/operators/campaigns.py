"""Campaign measurement: period summaries, rates, top and bottom lists, frequency efficiency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import dates
from tidemark.functions import numbers as num
from tidemark.functions import predicates as p
from tidemark.operators import ordering
from tidemark.plans.specs import CampaignSpec
from tidemark.sources import tables

IMPRESSION, CLICK, DISMISS = fixed.CAMPAIGN_ACTIONS


def campaign_rows(daily: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Rows of the period with a campaign id and a known action, with quarter and month."""
    rows = tables.between_days(daily, spec.start_date, spec.end_date)
    known = p.has_text(F.col("campaign_id")) & F.col("action").isin(fixed.CAMPAIGN_ACTIONS)
    return rows.where(known).withColumns(
        {"quarter": dates.quarter_label(F.col("ts")), "month": dates.month_label(F.col("ts"))}
    )


def _impressions() -> Column:
    return F.sum(F.when(F.col("action") == IMPRESSION, F.col("action_cnt")))


def _change(value: str, period: str, *same: str) -> Column:
    """Percent change to the period before, half-even to two places.

    Used on period summaries: a window holds one row per calendar period.
    """
    before = F.lag(value).over(Window.partitionBy(*same).orderBy(period))
    return num.half_even((num.ratio(F.col(value), before) - 1) * 100, 2)


def quarter_summary(rows: DataFrame) -> DataFrame:
    """Campaigns and impressions per quarter with their change; quarters without impressions fall out."""
    summary = (
        rows.where(F.col("quarter").isNotNull())
        .groupBy("quarter")
        .agg(
            F.count_distinct("campaign_id").alias("campaign_count"),
            _impressions().alias("impression_count"),
        )
        .where(F.col("impression_count").isNotNull())
    )
    return summary.select(
        "quarter",
        "campaign_count",
        F.coalesce(_change("campaign_count", "quarter"), F.lit(0.0)).alias("campaign_count_qoq"),
        "impression_count",
        F.coalesce(_change("impression_count", "quarter"), F.lit(0.0)).alias("impression_count_qoq"),
    )


def monthly_impressions(rows: DataFrame) -> DataFrame:
    """Impressions per month with their change; the first month has none."""
    months = (
        rows.where((F.col("action") == IMPRESSION) & F.col("month").isNotNull())
        .groupBy("month")
        .agg(F.sum("action_cnt").alias("impression_count"))
    )
    return months.withColumn("impression_count_mom", _change("impression_count", "month"))


def surface_summary(rows: DataFrame) -> DataFrame:
    """Campaigns, impressions and share of the quarter's impressions per surface."""
    by_surface = rows.groupBy("quarter", "surface").agg(
        F.count_distinct("campaign_id").alias("surface_campaign_count"),
        _impressions().alias("surface_impression_count"),
    )
    quarter = Window.partitionBy("quarter")
    shared = by_surface.withColumn("impression_count", F.sum("surface_impression_count").over(quarter))
    count = F.col("surface_impression_count")
    return shared.where(F.col("surface").isNotNull() & count.isNotNull()).withColumns(
        {
            "impression_distribution": num.half_even(num.ratio(count, F.col("impression_count")) * 100, 2),
            "impression_billionth": num.half_even(count.cast("double") / 1e9, 2),
        }
    )


def surface_pivot(
    summary: DataFrame, value: str, surfaces: Sequence[str] = tuple(fixed.CAMPAIGN_SURFACES)
) -> DataFrame:
    """Quarter x surface table of one value, 0 where a surface has none."""
    wide = summary.groupBy("quarter").pivot("surface", list(surfaces)).agg(F.first(value))
    return wide.na.fill(0)


def quarters_between(spec: CampaignSpec) -> list[str]:
    first, last = spec.start_date, spec.end_date
    start, end = first.year * 4 + (first.month - 1) // 3, last.year * 4 + (last.month - 1) // 3
    return [f"{n // 4}Q{n % 4 + 1}" for n in range(start, end + 1)]


def action_change(rows: DataFrame, quarters: Sequence[str]) -> DataFrame:
    """Counts per surface and action, a column per quarter, then the change from each to the next.

    Missing counts are zero; changes from zero are undefined and shown as zero.
    """
    rows = rows.where(F.col("surface").isNotNull() & F.col("action").isNotNull())
    wide = rows.groupBy("surface", "action").pivot("quarter", list(quarters)).agg(F.sum("action_cnt"))
    wide = wide.na.fill(0)
    changes = {
        f"{after}_qoq_change": F.coalesce(
            num.half_even((num.ratio(F.col(f"`{after}`"), F.col(f"`{before}`")) - 1) * 100, 2),
            F.lit(0.0),
        )
        for before, after in zip(quarters, quarters[1:])
    }
    return wide.withColumns(changes)


def _with_rates(rows: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Counts by action side by side, click and dismiss rate to four places."""
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    wide = rows.groupBy(*keys).pivot("action", fixed.CAMPAIGN_ACTIONS).agg(F.sum("action_cnt"))
    wide = wide.na.fill(0, fixed.CAMPAIGN_ACTIONS)
    return wide.withColumns(
        {
            f"{prefix}_ctr": num.half_even(num.ratio(F.col(CLICK), F.col(IMPRESSION)), 4),
            f"{prefix}_dismiss_rate": num.half_even(num.ratio(F.col(DISMISS), F.col(IMPRESSION)), 4),
        }
    )


def overall_rates(rows: DataFrame) -> DataFrame:
    return _with_rates(rows, ["surface", "quarter"], "overall")


def campaign_rates(rows: DataFrame, quarter: str) -> DataFrame:
    """Rates per campaign of a quarter next to the rates of its surface."""
    current = tables.between_days(rows, *dates.quarter_bounds(quarter))
    surface = _with_rates(current, ["surface"], "overall").drop(*fixed.CAMPAIGN_ACTIONS)
    return _with_rates(current, ["surface", "campaign_id"], "campaign").join(surface, "surface")


def top_and_bottom(rates: DataFrame, k: int = 5) -> DataFrame:
    """The k best and k worst campaigns of each surface by click rate; undefined rates are left out."""
    rated = rates.where(F.col("campaign_ctr").isNotNull())
    best = ordering.top_k(rated, "surface", "campaign_ctr", ["campaign_id"], k)
    worst = ordering.top_k(rated, "surface", "campaign_ctr", ["campaign_id"], k, ascending=True)
    return best.withColumn("list", F.lit("top")).unionByName(worst.withColumn("list", F.lit("bottom")))


def new_campaigns(rows: DataFrame, quarter: str) -> DataFrame:
    """Campaigns, compared in upper case, seen in the quarter and in no other loaded quarter."""
    here = F.col("quarter") == quarter
    return (
        rows.groupBy(F.upper("campaign_id").alias("campaign_id"))
        .agg(F.min(here).alias("_only"))
        .where(F.col("_only") & F.col("campaign_id").isNotNull())
        .select("campaign_id")
    )


def user_distribution(
    summary: DataFrame,
    name: str,
    quarters: Sequence[str],
    stats: Sequence[str] = tuple(fixed.USER_DISTRIBUTION_STATS),
) -> DataFrame:
    """Rows stat, columns quarter, from the columns whose name contains `name`."""
    chosen = [c for c in summary.columns if name in c and c != "quarter"]
    renamed = summary.select("quarter", *[F.col(c).alias(c.replace(f"{name}_", "")) for c in chosen])
    long = renamed.unpivot("quarter", [c for c in renamed.columns if c != "quarter"], "stat", "value")
    kept = long.where(F.col("stat").isin(list(stats)))
    return kept.groupBy("stat").pivot("quarter", list(quarters)).agg(F.first("value"))


def frequency_efficiency(
    frequency: DataFrame, campaign_id: str | None = None, users_above: int = 100, views_below: int = 16
) -> DataFrame:
    """Rates by how often users saw a campaign; all campaigns when none is named."""
    rows = frequency.where(
        (F.col("uu") > users_above) & (F.col("impression") > 0) & (F.col("impression") < views_below)
    )
    if campaign_id is not None:
        rows = rows.where(F.col("campaign_id") == campaign_id)
    total = F.col("total_impression")
    return (
        rows.withColumn("total_impression", F.col("uu") * F.col("impression"))
        .withColumns(
            {
                "ctr": num.half_even(num.ratio(F.col("total_click"), total), 4),
                "dismiss_rate": num.half_even(num.ratio(F.col("total_dismiss"), total), 4),
                "uu_million": F.col("uu") / F.lit(1e6),
            }
        )
        .withColumns({"ctr_pct": F.col("ctr") * 100, "dismiss_rate_pct": F.col("dismiss_rate") * 100})
        .withColumn("impression", F.col("impression").cast("int"))
    )
