"""How well predictions match outcomes: roll-ups, A/B read-outs, spread over simulations.

Everything is first summed per line item (partial sums map-side), then turned
into moments per group; moments merge, so no group is ever held in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import dates, delta, normal
from tidemark.functions import numbers as num
from tidemark.functions import predicates as p
from tidemark.operators import ordering
from tidemark.plans.specs import experiment_kind
from tidemark.sources import tables

METRICS = ("impressions", "conversions", "predicted_conversions", "revenue")
ARMS = ("control", "treatment")


def total(column: Column | str) -> Column:
    """Sum with 0 for nothing, in the type of the input: decimals stay exact."""
    return F.coalesce(F.sum(column), F.lit(0))


# --- roll-ups -----------------------------------------------------------------


def with_sla(df: DataFrame, pred: str = "conversions_pred", conv: str = "conversions") -> DataFrame:
    """Ratio (0 without conversions), open-band flag and revenue inside the band, per row."""
    return df.withColumns(
        {
            "calibration": num.ratio_or_zero(F.col(pred), F.col(conv)),
            "sla_flag": p.strictly_in_band(F.col(pred), F.col(conv)).cast("int"),
        }
    ).withColumn("rev_sla", F.col("sla_flag") * F.col("revenue"))


def line_items(
    served: DataFrame, by_sim: bool = False, goal: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One row per (simulation, further key and) line item with its band flag."""
    if goal is not None:
        served = served.where(F.col("optimization_goal") == goal)
    keys = [*(["sim_id"] if by_sim else []), *by, "line_item_id"]
    rolled = served.groupBy(*keys).agg(
        F.count("serve_item_id").alias("impressions"),
        total("conversions").alias("conversions"),
        total("predicted_conversions").alias("conversions_pred"),
        total("revenue").alias("revenue"),
    )
    return with_sla(rolled)


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have all keys: a NULL key is no group."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def _traffic_sums() -> list[Column]:
    return [
        F.sum("impressions").alias("impressions"),
        total(p.window_conversions()).alias("conversions"),
        total(p.goal_prediction()).alias("predicted_conversions"),
        F.sum("revenue").alias("revenue"),
    ]


def traffic(facts: DataFrame, start, end, grain: str | None = None) -> DataFrame:
    """All traffic of a date range: overall, or per day or week with account and size."""
    periods = {None: None, "day": F.col("served_date"), "week": dates.week_start(F.col("served_date"))}
    if grain not in periods:
        raise ValueError(f"grain is None, 'day' or 'week', not {grain!r}")
    keys = [F.col(c) for c in ("line_item_id", "model_type", "bid_strategy", "optimization_goal", "winner_bgid")]
    if grain:
        keys = [periods[grain].alias(grain), *keys, F.col("ad_account_id"), F.col("adv_size_by_revenue")]
    days = tables.between_days(facts, start, end, "served_date")
    return days.where(p.clean_traffic()).groupBy(*keys).agg(*_traffic_sums())


def latest_sizes(facts: DataFrame, start, look_back_days: int = 7) -> DataFrame:
    """Size label of each account from its newest row in the days up to the start.

    An aggregate in place of a window: rows of a busy account meet map-side
    first. Equal update times go to the larger label.
    """
    days = tables.between_days(facts, F.date_sub(dates.day(start), look_back_days), start, "served_date")
    newest = F.struct("account_updated_at", "adv_size_by_revenue")
    return days.groupBy("ad_account_id").agg(
        F.max_by("adv_size_by_revenue", newest).alias("adv_size_by_revenue")
    )


def ab_data(
    facts: DataFrame,
    accounts: DataFrame,
    start,
    end,
    kind: str,
    treatment: str,
    control: str,
    goal: str | None = None,
    drop_spam: bool = True,
    drop_house_ads: bool = True,
) -> DataFrame:
    """Traffic of two experiment groups by line item, with arm and account size.

    The label depends on the account alone, so it is joined after the roll-up,
    to far fewer rows than there are facts.
    """
    experiment_kind(kind)
    rows = tables.between_days(facts, start, end, "served_date")
    rows = rows.where(F.col("bgid").isin(control, treatment))
    rows = rows.where(p.clean_traffic(spam=drop_spam, anomalies=drop_spam, house_ads=drop_house_ads))
    if goal is not None:
        rows = rows.where(F.col("optimization_goal") == goal)
    rolled = rows.groupBy(
        "line_item_id", "ad_account_id", "model_type", "bid_strategy", "optimization_goal",
        p.arm_label(F.col("bgid"), control).alias("treatment_group"),
    ).agg(*_traffic_sums())
    sized = rolled.join(latest_sizes(accounts, start), "ad_account_id", "left")
    return sized.withColumn(
        "adv_size_by_revenue", F.coalesce("adv_size_by_revenue", F.lit(fixed.UNKNOWN_SIZE))
    )


def ab_wide(
    data: DataFrame, keys: Sequence[str] = ("line_item_id", "bid_strategy", "optimization_goal")
) -> DataFrame:
    """Arms side by side as metric_arm columns; an item missing in one arm gets zeros there.

    Rows with a NULL key are left out.
    """
    for key in keys:
        data = data.where(F.col(key).isNotNull())
    columns = [
        total(F.when(F.col("treatment_group") == arm, F.col(metric))).alias(f"{metric}_{arm}")
        for metric in METRICS
        for arm in ARMS
    ]
    return data.groupBy(*keys).agg(*columns)


# --- A/B read-out ---------------------------------------------------------------

PAIRED = tuple(
    f"{metric}_{arm}" for arm in ARMS for metric in ("predicted_conversions", "conversions", "revenue")
)


def arm_moments() -> list[Column]:
    """Calibration and share of revenue in the closed band per arm, each with its variance."""
    columns = []
    for arm in ARMS:
        pred, conv, rev = (
            F.col(f"{m}_{arm}") for m in ("predicted_conversions", "conversions", "revenue")
        )
        inside = F.when(p.in_band(pred, conv), rev).otherwise(F.lit(0))
        columns += [
            delta.ratio_of_means(pred, conv).alias(f"cali_{arm[0]}"),
            delta.ratio_variance(pred, conv).alias(f"cali_{arm[0]}_var"),
            delta.ratio_of_means(inside, rev).alias(f"perc_rev_sla_{arm[0]}"),
            delta.ratio_variance(inside, rev).alias(f"perc_rev_sla_{arm[0]}_var"),
        ]
    return columns


def _root(value: Column) -> Column:
    return F.when(value >= 0, F.sqrt(value))


def with_differences(moments: DataFrame, confidence: float) -> DataFrame:
    """Intervals per arm, and difference, standard error, interval and widths between arms."""
    z = F.lit(normal.two_sided_z(confidence))
    metrics = ("cali", "perc_rev_sla")
    variances = [f"{m}_{arm}_var" for m in metrics for arm in "tc"]
    kept = [c for c in moments.columns if c not in variances]
    # Half widths per arm, then everything that follows from them, each in one projection.
    halves, columns = [], []
    for metric in metrics:
        t, c = F.col(f"{metric}_t"), F.col(f"{metric}_c")
        t_var, c_var = F.col(f"{metric}_t_var"), F.col(f"{metric}_c_var")
        difference = F.abs(t - 1) - F.abs(c - 1) if metric == "cali" else t - c
        halves += [
            (z * _root(t_var)).alias(f"_{metric}_t"),
            (z * _root(c_var)).alias(f"_{metric}_c"),
            difference.alias(f"{metric}_d"),
            _root(t_var + c_var).alias(f"{metric}_d_se"),
        ]
        d, se = F.col(f"{metric}_d"), F.col(f"{metric}_d_se")
        half, width = z * se, F.lit(2.0) * z * se
        columns += [
            *[(F.col(f"{metric}_{arm}") - F.col(f"_{metric}_{arm}")).alias(f"{metric}_{arm}_lo") for arm in "tc"],
            *[(F.col(f"{metric}_{arm}") + F.col(f"_{metric}_{arm}")).alias(f"{metric}_{arm}_hi") for arm in "tc"],
            d, se,
            (d - half).alias(f"{metric}_d_lo"),
            (d + half).alias(f"{metric}_d_hi"),
            width.alias(f"{metric}_d_ci_width"),
            F.try_divide(width, F.abs(d)).alias(f"{metric}_d_ci_width_rel"),
        ]
    return moments.select(*kept, *halves).select(*kept, *columns)


def goal_labels(df: DataFrame) -> Column:
    """'Overall' and the row's own goal, to feed both read-outs in one pass."""
    overall = F.lit(fixed.OVERALL)
    if "optimization_goal" not in df.columns:
        return F.array(overall)
    return F.array_compact(F.array(overall, F.col("optimization_goal")))


def ab_readout(
    wide: DataFrame, confidence: float = 95, item: str = "line_item_id", by: Sequence[str] = ()
) -> DataFrame:
    """One row 'Overall' and one per goal (and per `by` segment).

    Items are summed within the goal first; goals and the overall row come from
    one scan and one shuffle on (goal, item).
    """
    labelled = wide.withColumn("_goal", F.explode(goal_labels(wide)))
    items = (
        labelled.where(F.col(item).isNotNull())
        .groupBy(*by, F.col("_goal").alias("optimization_goal"), item)
        .agg(*[total(c).alias(c) for c in PAIRED])
    )
    moments = items.groupBy(*by, "optimization_goal").agg(*arm_moments())
    return with_differences(moments, confidence)


def readout_text(readout: DataFrame) -> DataFrame:
    """Display columns of a read-out; further work uses the numbers."""
    texts = {}
    for arm in ("t", "c"):
        texts[f"cali_{arm}_text"] = num.interval_text(
            F.col(f"cali_{arm}"), F.col(f"cali_{arm}_lo"), F.col(f"cali_{arm}_hi")
        )
        texts[f"perc_rev_sla_{arm}_text"] = num.percent_interval_text(
            F.col(f"perc_rev_sla_{arm}"), F.col(f"perc_rev_sla_{arm}_lo"), F.col(f"perc_rev_sla_{arm}_hi")
        )
    return readout.withColumns(texts)


def calibration_readout(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calibration and share of revenue in the closed band over line items, with variances."""
    pred, conv, rev = F.col("conversions_pred"), F.col("conversions"), F.col("revenue")
    inside = F.when(p.in_band(pred, conv), rev).otherwise(F.lit(0.0))
    return keyed(items, by).groupBy(*by).agg(
        F.count("*").alias("line_items"),
        delta.ratio_of_means(pred, conv).alias("calibration"),
        delta.ratio_variance(pred, conv).alias("calibration_var"),
        delta.ratio_of_means(inside, rev).alias("pct_rev_sla"),
        delta.ratio_variance(inside, rev).alias("pct_rev_sla_var"),
        num.ratio(F.sum("rev_sla"), F.sum(rev)).alias("pct_rev_sla_open"),
    )


def weighted_calibration(
    items: DataFrame, weight: str = "revenue", pred: str = "conversions_pred", conv: str = "conversions",
    by: Sequence[str] = (),
) -> DataFrame:
    """Weighted calibration and weighted absolute error, plain, symmetric and add-one smoothed.

    A ratio without conversions is undefined, so the unsmoothed measures are
    taken over the rows that have some; the others are counted, and the
    smoothed measure covers all rows.
    """
    w, pr, cv = (F.col(c).cast("double") for c in (weight, pred, conv))
    rate = F.try_divide(pr, cv)
    defined = F.when(rate.isNotNull(), w)
    symmetric = F.when(rate > 1, F.lit(1.0) - F.try_divide(cv, pr)).otherwise(F.lit(1.0) - rate)
    smoothed = F.when(cv == 0, pr + 1).otherwise(rate)
    parts = {
        "weighted_calibration": w * rate,
        "weighted_abs_error": w * F.abs(rate - 1),
        "weighted_abs_error_symmetric": w * symmetric,
    }
    columns = []
    for name, value in parts.items():
        columns += [
            delta.ratio_of_means(value, defined).alias(name),
            delta.ratio_variance(value, defined).alias(f"{name}_var"),
        ]
    return keyed(items, by).groupBy(*by).agg(
        *columns,
        num.ratio(F.avg(w * smoothed), F.avg(w)).alias("weighted_calibration_smoothed"),
        F.count(F.when(rate.isNull(), 1)).alias("rows_without_conversions"),
    )


# --- spread over simulations ------------------------------------------------------


def totals(items: DataFrame, by: Sequence[str] = ("sim_id",)) -> DataFrame:
    """Sums, calibration and share of revenue in the band, per simulation or (by=()) overall."""
    sums = ("revenue", "impressions", "rev_sla", "conversions", "conversions_pred")
    rolled = keyed(items, by).groupBy(*by).agg(*[total(c).alias(c) for c in sums])
    return rolled.withColumns(
        {
            "pct_rev_sla": num.ratio(F.col("rev_sla"), F.col("revenue")),
            "calibration": num.ratio_or_zero(F.col("conversions_pred"), F.col("conversions")),
        }
    )


def percentile_interval(df: DataFrame, metrics: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Mean of each metric with the length and half length of its percentile interval."""
    # One row per simulation, read several times.
    df = ordering.settle(df.select(*metrics))
    shares = [(1 - confidence) / 2, (1 + confidence) / 2]
    ends = ordering.exact_percentiles(df, {m: shares for m in metrics})
    lines = []
    for m in metrics:
        length = ends[m][1] - ends[m][0]
        lines.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).alias("mean"),
                length.alias("ci_length"),
                (length / 2).alias("half_ci"),
                num.ratio(length, F.col(m)).alias("relative_length"),
            )
        )
    return df.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.inline(F.array(*lines)))


def simulation_variance(items: DataFrame) -> DataFrame:
    """Variance seen across simulations against the mean delta-method variance within them."""
    across = totals(items).agg(
        F.var_samp("calibration").alias("calibration_empirical"),
        F.var_samp("pct_rev_sla").alias("pct_rev_sla_empirical"),
    )
    within = calibration_readout(items, ["sim_id"]).agg(
        F.avg("calibration_var").alias("calibration_delta"),
        F.avg("pct_rev_sla_var").alias("pct_rev_sla_delta"),
    )

    def line(metric: str) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.col(f"{metric}_empirical").alias("empirical_var"),
            F.col(f"{metric}_delta").alias("delta_var"),
            num.ratio(F.col(f"{metric}_empirical"), F.col(f"{metric}_delta")).alias("ratio"),
        )

    both = across.withColumn("_within", within.select(F.struct("*")).scalar()).select("*", "_within.*")
    return both.select(F.inline(F.array(line("calibration"), line("pct_rev_sla"))))


# --- distributions -----------------------------------------------------------------


def iqr_outliers(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Add <column>_outlier: outside reach x the interquartile range, on raw values."""
    ends = ordering.exact_percentiles(df, {c: [0.25, 0.75] for c in columns})
    flags = {}
    for name in columns:
        low, high = ends[name][0], ends[name][1]
        margin = F.lit(reach) * (high - low)
        flags[f"{name}_outlier"] = (F.col(name) < low - margin) | (F.col(name) > high + margin)
    return df.withColumns(flags)


def histogram(df: DataFrame, value: Column, by: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """Counts in equal-width bins 1..bins between the least and the greatest value."""
    rows = df.select(*by, value.cast("double").alias("_value")).where(F.col("_value").isNotNull())
    ends = rows.agg(F.struct(F.min("_value").alias("low"), F.max("_value").alias("high"))).scalar()
    low, high = ends.getField("low"), ends.getField("high")
    width = (high - low) / bins
    bin_no = F.least(
        F.coalesce(F.floor(F.try_divide(F.col("_value") - low, width)), F.lit(0)) + 1, F.lit(bins)
    )
    return (
        rows.groupBy(*by, bin_no.cast("int").alias("bin"))
        .agg(F.count("*").alias("rows"))
        .withColumns(
            {"bin_low": low + (F.col("bin") - 1) * width, "bin_high": low + F.col("bin") * width}
        )
    )


def cumulative_deciles(
    df: DataFrame, rank_by: Sequence[str], metrics: Sequence[str], tie: Sequence[str], buckets: int = 10
) -> DataFrame:
    """Equal-count deciles by each rank_by column: sum and running share (in percent) of each metric.

    All columns are ranked in one pass over rows stacked by column.
    """
    stacked = F.array(*[F.struct(F.lit(c).alias("rank_by"), F.col(c).cast("double").alias("_value")) for c in rank_by])
    rows = df.select(*tie, *metrics, F.inline(stacked))
    ranked = ordering.row_numbers(rows, ["rank_by"], ["_value", *tie], "_rank", size="_size")
    decile = ordering.equal_count_bucket(F.col("_rank"), F.col("_size"), buckets)
    parts = ranked.groupBy("rank_by", decile.alias("decile")).agg(
        F.count("*").alias("rows"), *[F.sum(m).cast("double").alias(m) for m in metrics]
    )
    # One row per column and decile from here on.
    whole = Window.partitionBy("rank_by")
    upto = whole.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumns(
        {
            f"{m}_cum_pct": F.try_divide(F.sum(m).over(upto), F.sum(m).over(whole)) * F.lit(100.0)
            for m in metrics
        }
    )


# --- weekly series -------------------------------------------------------------------


def _weekly(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rolled = keyed(df, keys).groupBy(*keys).agg(
        *[total(c).alias(c) for c in ("conversions", "predicted_conversions", "revenue")]
    )
    return with_sla(rolled, pred="predicted_conversions")


def _share_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rolled = df.groupBy(*keys).agg(
        *[total(c).alias(c) for c in ("conversions", "predicted_conversions", "revenue", "rev_sla")]
    )
    return rolled.withColumn("pct_rev_sla", num.ratio(F.col("rev_sla"), F.col("revenue")))


def weekly_by_size(traffic_rows: DataFrame, goal: str | None = None, period: str = "week") -> DataFrame:
    """Account x period first, then period x account size."""
    rows = traffic_rows if goal is None else traffic_rows.where(F.col("optimization_goal") == goal)
    accounts = _weekly(rows, [period, "ad_account_id", "adv_size_by_revenue"])
    return _share_by(accounts, [period, "adv_size_by_revenue"])


def weekly_overall(traffic_rows: DataFrame, goal: str | None = None, period: str = "week") -> DataFrame:
    """Line item x period first, then period."""
    rows = traffic_rows if goal is None else traffic_rows.where(F.col("optimization_goal") == goal)
    return _share_by(_weekly(rows, [period, "line_item_id"]), [period])


def weekly_variation(overall: DataFrame, by_size: DataFrame) -> DataFrame:
    """Coefficient of variation over periods, for all line items and per account size."""
    labelled = overall.select(F.lit("Line Item Level").alias("label"), "pct_rev_sla").unionByName(
        by_size.select(F.col("adv_size_by_revenue").alias("label"), "pct_rev_sla")
    )
    spread = labelled.groupBy("label").agg(
        F.avg("pct_rev_sla").alias("mean"), F.stddev_samp("pct_rev_sla").alias("std")
    )
    return spread.withColumn("cv", num.ratio(F.col("std"), F.col("mean"))).withColumn(
        "cv_pct", F.col("cv") * F.lit(100.0)
    )


def weekly_size_share(by_size: DataFrame, period: str = "week") -> DataFrame:
    """Share of the period's revenue by account size, in percent."""
    week = Window.partitionBy(period)
    return by_size.select(
        period,
        "adv_size_by_revenue",
        "revenue",
        (num.ratio(F.col("revenue"), F.sum("revenue").over(week)) * F.lit(100.0)).alias("pct_revenue"),
    )


def weekly_size_pivot(by_size: DataFrame, sizes: Sequence[str], period: str = "week") -> DataFrame:
    """Revenue in millions, one column per account size, 0 where a size has none."""
    wide = by_size.groupBy(period).pivot("adv_size_by_revenue", list(sizes)).agg(F.sum("revenue"))
    millions = [(F.coalesce(F.col(s), F.lit(0)).cast("double") / 1e6).alias(s) for s in sizes]
    return wide.select(period, *millions)
