"""Registered campaign queries over the role views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions import predicates as p
from tidemark.functions import text as tx
from tidemark.operators import campaigns as op
from tidemark.plans.calibration_queries import rounded
from tidemark.plans.specs import CampaignSpec
from tidemark.sources import roles

SPEC = CampaignSpec(dt.date(2000, 3, 31), 8).check(earliest=None)
QUARTERS = op.quarters_between(SPEC)


def _rows(spark, sf_dir):
    return op.campaign_rows(roles.campaign_daily(spark, sf_dir), SPEC)


def campaign_summary(spark, sf_dir):
    return rounded(op.quarter_summary(_rows(spark, sf_dir)))


def campaign_monthly(spark, sf_dir):
    return rounded(op.monthly_impressions(_rows(spark, sf_dir)))


def surface_share(spark, sf_dir):
    return rounded(op.surface_summary(_rows(spark, sf_dir)))


def surface_pivot(spark, sf_dir):
    return op.surface_pivot(op.surface_summary(_rows(spark, sf_dir)), "surface_campaign_count")


def surface_pivot_billions(spark, sf_dir):
    return rounded(op.surface_pivot(op.surface_summary(_rows(spark, sf_dir)), "impression_billionth"))


def action_qoq(spark, sf_dir):
    return rounded(op.action_change(_rows(spark, sf_dir), QUARTERS))


def overall_rates(spark, sf_dir):
    return rounded(op.overall_rates(_rows(spark, sf_dir)))


def campaign_rates(spark, sf_dir):
    return rounded(op.campaign_rates(_rows(spark, sf_dir), SPEC.quarter))


def campaign_top_bottom(spark, sf_dir):
    return rounded(op.top_and_bottom(op.campaign_rates(_rows(spark, sf_dir), SPEC.quarter)))


def new_campaigns(spark, sf_dir):
    return op.new_campaigns(_rows(spark, sf_dir), SPEC.quarter)


def user_distribution(spark, sf_dir):
    summary = roles.campaign_user_summary(spark, sf_dir)
    parts = [
        op.user_distribution(summary, name, QUARTERS).withColumn("measure", F.lit(name))
        for name in ("campaign", "impression")
    ]
    return rounded(parts[0].unionByName(parts[1]))


def frequency_efficiency(spark, sf_dir):
    return rounded(op.frequency_efficiency(roles.campaign_frequency(spark, sf_dir), users_above=2))


def date_values(spark, sf_dir):
    """Day codes read back, months before a day, hash arms and lenient whole numbers, over orders."""
    day = F.col("o_orderdate").cast("date")
    code = dates.day_code(day)
    noisy = F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(""))
    return roles.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        code.alias("day_code"),
        dates.parse_day_code(code).cast("string").alias("day"),
        dates.months_before(day, 3).cast("string").alias("three_months_before"),
        tx.lenient_int(noisy).alias("whole"),
        p.hash_arm(F.col("o_orderkey")).alias("arm"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        campaign_summary, campaign_monthly, surface_share, surface_pivot, surface_pivot_billions, action_qoq,
        overall_rates, campaign_rates, campaign_top_bottom, new_campaigns, user_distribution,
        frequency_efficiency, date_values,
    )
}
