"""Registered calibration queries over the role views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as num
from tidemark.operators import calibration as op
from tidemark.operators import ordering, trimming
from tidemark.plans import weekly
from tidemark.sources import roles, tables

START, END = "1996-01-01", "2000-12-31"
FIRST_DAYS_END = "1998-06-30"
SIZES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "GROWTH", "HOUSEHOLD", "MACHINERY")
PCTS = tuple(range(10))
DIMENSIONS = ("impressions_control", "conversions_control")
GOALS = ("Overall", "APP_INSTALLS")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison; adding zero turns -0.0 into 0.0."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif kind == "date":
            column = column.cast("string")
        columns.append(column.alias(name))
    return df.select(*columns)


def _items(spark, sf_dir, **options):
    return op.line_items(roles.served_items(spark, sf_dir), **options)


def calibration_overall(spark, sf_dir):
    return rounded(op.calibration_readout(_items(spark, sf_dir)), 10)


def calibration_by_goal(spark, sf_dir):
    found = op.calibration_readout(_items(spark, sf_dir, by=["optimization_goal"]), ["optimization_goal"])
    return rounded(found.withColumnRenamed("optimization_goal", "goal"), 10)


def item_sample(spark, sf_dir):
    """A repeatable tenth of the line items."""
    found = ordering.sample_share(_items(spark, sf_dir), "line_item_id", 0.1)
    return rounded(found.select("line_item_id", "revenue"))


def line_item_sla(spark, sf_dir):
    return rounded(_items(spark, sf_dir, by_sim=True))


def traffic_total(spark, sf_dir):
    return rounded(op.traffic(roles.ad_facts(spark, sf_dir), START, END))


def traffic_daily(spark, sf_dir):
    return rounded(op.traffic(roles.ad_facts(spark, sf_dir), START, END, "day"))


def traffic_weekly(spark, sf_dir):
    return rounded(op.traffic(roles.ad_facts(spark, sf_dir), START, END, "week"))


def account_sizes(spark, sf_dir):
    return op.latest_sizes(roles.ad_facts(spark, sf_dir), START, 700)


def _ab(spark, sf_dir, **options):
    facts = roles.ad_facts(spark, sf_dir)
    return op.ab_data(facts, facts, START, END, "Amalgam", "BG_T", "BG_C", **options)


def ab_rollup(spark, sf_dir):
    return rounded(_ab(spark, sf_dir))


def ab_rollup_goal_unfiltered(spark, sf_dir):
    return rounded(_ab(spark, sf_dir, goal="PIXEL_PURCHASE", drop_spam=False, drop_house_ads=False))


def ab_wide(spark, sf_dir):
    return rounded(op.ab_wide(_ab(spark, sf_dir)))


def ab_readout(spark, sf_dir):
    return rounded(op.ab_readout(op.ab_wide(_ab(spark, sf_dir))), 8)


def ab_readout_text(spark, sf_dir):
    """Display columns of the read-out, from its rounded numbers."""
    shown = op.readout_text(rounded(op.ab_readout(op.ab_wide(_ab(spark, sf_dir))), 8))
    return shown.select("optimization_goal", *[c for c in shown.columns if c.endswith("_text")])


def ab_readout_by_size(spark, sf_dir):
    wide = op.ab_wide(_ab(spark, sf_dir), ("ad_account_id", "adv_size_by_revenue", "optimization_goal"))
    return rounded(op.ab_readout(wide, item="ad_account_id", by=["adv_size_by_revenue"]), 8)


def weighted_calibration(spark, sf_dir):
    return rounded(
        op.weighted_calibration(_items(spark, sf_dir)).select(
            "weighted_calibration", "weighted_calibration_var", "weighted_calibration_smoothed",
            "rows_without_conversions",
        ),
        10,
    )


def weighted_abs_error(spark, sf_dir):
    measures = op.weighted_calibration(_items(spark, sf_dir, by_sim=True), by=["sim_id"])
    return rounded(measures.select("sim_id", *[c for c in measures.columns if c.startswith("weighted_abs")]), 8)


def _facts_read(spark, sf_dir):
    """Rows of the largest table behind the facts; the count is read from the footers of its files."""
    return roles.table(spark, sf_dir, "lineitem").count()


def trim_rows(spark, sf_dir):
    wide = op.ab_wide(_ab(spark, sf_dir))
    return rounded(trimming.trim(wide, "revenue_control", 5, "both", _facts_read(spark, sf_dir)))


def _cells(spark, sf_dir):
    wide = op.ab_wide(_ab(spark, sf_dir))
    return trimming.readouts(
        wide, DIMENSIONS, ("left", "right"), PCTS, GOALS, rows_read=_facts_read(spark, sf_dir)
    )


def trim_grid(spark, sf_dir):
    return rounded(trimming.revenue_summary(_cells(spark, sf_dir), GOALS), 5)


def trim_estimates(spark, sf_dir):
    return rounded(trimming.estimates(_cells(spark, sf_dir), GOALS), 7)


def sim_totals(spark, sf_dir):
    return rounded(op.totals(_items(spark, sf_dir, by_sim=True)))


def population_totals(spark, sf_dir):
    return rounded(op.totals(_items(spark, sf_dir), by=()))


def sim_interval(spark, sf_dir):
    sims = op.totals(_items(spark, sf_dir, by_sim=True))
    return rounded(op.percentile_interval(sims, ["pct_rev_sla", "calibration"]), 8)


def sim_variance(spark, sf_dir):
    return rounded(op.simulation_variance(_items(spark, sf_dir, by_sim=True)), 9)


def iqr_outliers(spark, sf_dir):
    flagged = op.iqr_outliers(_items(spark, sf_dir), ["rev_sla", "calibration", "revenue"])
    return flagged.select(
        "line_item_id",
        *[F.col(f"{c}_outlier").cast("int").alias(f"{c}_outlier") for c in ("rev_sla", "calibration", "revenue")],
    )


def histogram_bins(spark, sf_dir):
    items = _items(spark, sf_dir)
    return rounded(op.histogram(items, num.log_shifted(F.col("revenue")), ["sla_flag"]))


def histogram_impressions(spark, sf_dir):
    return rounded(op.histogram(_items(spark, sf_dir), F.col("impressions")))


def decile_cumulative(spark, sf_dir):
    wide = op.ab_wide(_ab(spark, sf_dir))
    ties = ("line_item_id", "bid_strategy", "optimization_goal")
    return rounded(op.cumulative_deciles(wide, DIMENSIONS, ("revenue_control", "conversions_control"), ties))


def _traffic_weeks(spark, sf_dir):
    return op.traffic(roles.ad_facts(spark, sf_dir), START, END, "week")


def weekly_sla(spark, sf_dir):
    return rounded(op.weekly_overall(_traffic_weeks(spark, sf_dir)))


def weekly_sla_by_size(spark, sf_dir):
    return rounded(op.weekly_by_size(_traffic_weeks(spark, sf_dir), goal="APP_INSTALLS"))


def weekly_cv(spark, sf_dir):
    weeks = ordering.settle(_traffic_weeks(spark, sf_dir))
    return rounded(op.weekly_variation(op.weekly_overall(weeks), op.weekly_by_size(weeks)), 8)


def weekly_sla_stored(spark, sf_dir):
    """weekly_sla from stored sums per day: some days first, and a second run that adds the others."""
    path = f"{ordering.ensure_checkpoint_dir(spark)}/weekly-{uuid.uuid4().hex}"
    facts = roles.ad_facts(spark, sf_dir)
    weekly.store_days(facts, START, FIRST_DAYS_END, path)
    weekly.store_days(facts, START, END, path)
    found = ordering.settle(rounded(op.weekly_overall(weekly.weeks(spark, path, START, END))))
    tables.remove(spark, path)
    return found


def weekly_size_share(spark, sf_dir):
    return rounded(op.weekly_size_share(op.weekly_by_size(_traffic_weeks(spark, sf_dir))))


def weekly_size_pivot(spark, sf_dir):
    return rounded(op.weekly_size_pivot(op.weekly_by_size(_traffic_weeks(spark, sf_dir)), SIZES), 10)


QUERIES = {
    f.__name__: f
    for f in (
        calibration_overall, calibration_by_goal, item_sample, line_item_sla, traffic_total, traffic_daily, traffic_weekly,
        account_sizes, ab_rollup, ab_rollup_goal_unfiltered, ab_wide, ab_readout, ab_readout_text, ab_readout_by_size,
        weighted_calibration, weighted_abs_error, trim_rows, trim_grid, trim_estimates, sim_totals,
        population_totals, sim_interval, sim_variance, iqr_outliers, histogram_bins, histogram_impressions,
        decile_cumulative, weekly_sla, weekly_sla_stored, weekly_sla_by_size, weekly_cv, weekly_size_share, weekly_size_pivot,
    )
}
