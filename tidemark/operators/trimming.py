"""Dropping the tails of a dimension, and how the read-out changes with the cut.

Each row is sent once to the partition of its line item and only there spread
over the cuts that keep it, so the shuffle does not grow with the grid. Partitions
grow in number with the rows, so that a task's sums do not grow with the input.
Cells then meet as merged moments, a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import numbers as num
from tidemark.operators import calibration, ordering

DIRECTIONS = ("left", "right", "both")
CELL = ("dimension", "direction", "pct_cut", "optimization_goal")
UNCUT = "none"
#: Sums per item and series that one task holds at most, about, however many rows there are.
SUMS_PER_TASK = 400_000


def _check(df: DataFrame, dimension: str, directions: Sequence[str]) -> None:
    if dimension not in df.columns:
        raise ValueError(f"no column {dimension!r}; there are {df.columns}")
    for direction in directions:
        if direction not in DIRECTIONS:
            raise ValueError(f"direction is one of {DIRECTIONS}, not {direction!r}")


def _kept(value: Column, direction: str, low: Column, high: Column) -> Column:
    """Both thresholds stay in: rows equal to a threshold are kept."""
    if direction == "left":
        return value >= low
    if direction == "right":
        return value <= high
    return (value >= low) & (value <= high)


def trim(wide: DataFrame, dimension: str, pct: float, direction: str = "left", rows_read: int = 0) -> DataFrame:
    """Rows outside the cut tail(s); rows with a NULL dimension fall out. rows_read: how many wide is made from, if known."""
    _check(wide, dimension, [direction])
    wide = ordering.settle(wide, rows_read)
    ends = ordering.exact_percentiles(wide, {dimension: [pct / 100, (100 - pct) / 100]})[dimension]
    return wide.where(_kept(F.col(dimension).cast("double"), direction, ends[0], ends[1]))


def readouts(
    wide: DataFrame,
    dimensions: Sequence[str],
    directions: Sequence[str],
    pcts: Sequence[float],
    goals: Sequence[str] | None = None,
    confidence: float = 95,
    item: str = "line_item_id",
    rows_read: int = 0,
) -> DataFrame:
    """A/B read-out of every grid cell and, with direction 'none', of the uncut rows.

    A larger cut keeps a subset of a smaller one, so a row is described by the
    number of cuts that keep it. Rows of an item that agree in it are summed
    before they are spread over the cuts.

    rows_kept, revenue_kept and conversions_kept are those of the whole cell.
    Cells left with fewer than two rows are dropped.
    rows_read: how many rows wide is made from, if known; its roll-up is dealt to more tasks if they are many.
    """
    for dimension in dimensions:
        _check(wide, dimension, directions)
    cuts = sorted(float(pct) for pct in pcts)
    # Several scans follow; only the columns that they read are kept.
    needed = [item, *dict.fromkeys((*dimensions, *calibration.PAIRED)), *_goal_column(wide)]
    wide = ordering.settle(wide.where(F.col(item).isNotNull()).select(*needed), rows_read)
    shares = [*(cut / 100 for cut in cuts), *((100 - cut) / 100 for cut in cuts)]
    thresholds = ordering.exact_percentiles(wide, {d: shares for d in dimensions})
    names, survived_cuts = [], []
    for dimension in dimensions:
        value, ends = F.col(dimension).cast("double"), F.col(f"_ends_{dimension}")
        names.append((dimension, UNCUT))
        survived_cuts.append(value.isNotNull().cast("int"))
        for direction in directions:
            names.append((dimension, direction))
            survived_cuts.append(_cuts_survived(value, direction, ends, len(cuts)))
    # A small number stands for (dimension, direction) until the rows are few.
    survived = {f"_cuts_{i}": c for i, c in enumerate(survived_cuts, 1)}
    series = [F.struct(F.lit(i).alias("_no"), F.col(f"_cuts_{i}").alias("_cuts")) for i in range(1, len(names) + 1)]
    labels = calibration.goal_labels(wide)
    if goals is not None:
        wanted = [fixed.OVERALL, *goals]
        labels = F.filter(labels, lambda g: g.isin(wanted))
    sums = [
        F.sum("_rows").alias("_rows"),
        *[calibration.total(c).alias(c) for c in calibration.PAIRED],
    ]
    keys = ["_no", "optimization_goal", item]
    # A row becomes a sum in every series, overall and for its goal. A count that is given is kept as it is.
    most = wide.count() * len(names) * (1 + len(_goal_column(wide)))
    parts = max(wide.sparkSession.sparkContext.defaultParallelism, -(-most // SUMS_PER_TASK))
    placed = wide.repartition(parts, item)
    placed = placed.withColumns({f"_ends_{d}": thresholds[d] for d in dimensions}).withColumns(survived)
    placed = placed.drop(*[f"_ends_{d}" for d in dimensions])
    rows = placed.select(
        "*", F.lit(1).alias("_rows"), F.explode(labels).alias("_goal"), F.array(*series).alias("_series")
    ).select("*", F.inline("_series"))
    rows = rows.drop("optimization_goal").withColumnRenamed("_goal", "optimization_goal")
    survived = rows.where(F.col("_cuts") > 0).groupBy(*keys, "_cuts").agg(*sums)
    # From the rows that survive most cuts to those that survive least, an item's running sums are its sums in the cuts
    # from the next lower number of survived ones up: they go to the cells at once and no task holds them per cut.
    nested = Window.partitionBy(*keys).orderBy(F.desc("_cuts"))
    upto = nested.rowsBetween(Window.unboundedPreceding, 0)
    summed = survived.select(
        *keys,
        *[F.sum(c).over(upto).alias(c) for c in ("_rows", *calibration.PAIRED)],
        (F.lead("_cuts", 1, 0).over(nested) + 1).alias("_first"),
        "_cuts",
    )
    items = summed.withColumn("_cut", F.explode(F.sequence(F.col("_first"), F.col("_cuts"))))
    moments = items.groupBy("_no", "optimization_goal", "_cut").agg(
        *calibration.arm_moments(),
        F.sum("_rows").alias("rows_kept"),
        F.sum(F.col("revenue_control") + F.col("revenue_treatment")).alias("revenue_kept"),
        F.sum(F.col("conversions_control") + F.col("conversions_treatment")).alias("conversions_kept"),
    )
    # One row per cell and goal from here on: the size of the grid, not of the data.
    same_cell = Window.partitionBy("_no", "_cut")
    overall = F.col("optimization_goal") == fixed.OVERALL
    whole = {
        c: F.max(F.when(overall, F.col(c))).over(same_cell)
        for c in ("rows_kept", "revenue_kept", "conversions_kept")
    }
    pct = F.when(
        F.col("direction") != UNCUT, F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("_cut"))
    )
    named = {
        part: F.element_at(F.array(*[F.lit(n[i]) for n in names]), F.col("_no"))
        for i, part in enumerate(("dimension", "direction"))
    }
    cells = moments.withColumns(whole).where(F.col("rows_kept") >= 2)
    cells = cells.withColumns(named).withColumn("pct_cut", pct).drop("_no", "_cut")
    return calibration.with_differences(cells, confidence)


def _goal_column(wide: DataFrame) -> list[str]:
    return ["optimization_goal"] if "optimization_goal" in wide.columns else []


def _cuts_survived(value: Column, direction: str, ends: Column, cuts: int) -> Column:
    """How many of the nested cuts keep the value; NULL values survive none. ends: low thresholds, then high ones."""
    lows, highs = F.slice(ends, 1, cuts), F.slice(ends, cuts + 1, cuts)
    kept = F.zip_with(lows, highs, lambda low, high: _kept(value, direction, low, high))
    return F.coalesce(F.size(F.filter(kept, lambda k: k)), F.lit(0))


def revenue_summary(cells: DataFrame, goals: Sequence[str] = (fixed.OVERALL,)) -> DataFrame:
    """What each cut costs in revenue and conversions and gains in interval width."""
    uncut = F.col("direction") == UNCUT
    same_goal = Window.partitionBy("dimension", "optimization_goal")

    def base(column: str) -> Column:
        return F.max(F.when(uncut, F.col(column))).over(same_goal)

    out = cells.where(F.col("optimization_goal").isin(list(goals)))
    for kept, name in (("revenue_kept", "revenue"), ("conversions_kept", "conversion")):
        lost = base(kept) - F.col(kept)
        out = out.withColumn(f"{name}_cut_out", lost).withColumn(
            f"{name}_cut_out_pct",
            F.when(base(kept) > 0, num.ratio(lost, base(kept)) * F.lit(100.0)).otherwise(F.lit(0.0)),
        )
    for metric in ("cali", "perc_rev_sla"):
        width = f"{metric}_d_ci_width"
        gained = base(width) - F.col(width)
        out = out.withColumn(f"{metric}_d_ci_reduction", gained).withColumn(
            f"{metric}_d_ci_reduction_pct",
            F.when(base(width) > 0, num.ratio(gained, base(width)) * F.lit(100.0)).otherwise(F.lit(0.0)),
        )
    return out.where(~uncut).select(
        *CELL,
        "revenue_cut_out", "revenue_cut_out_pct", "conversion_cut_out", "conversion_cut_out_pct",
        "cali_d_ci_width", "cali_d_ci_reduction", "cali_d_ci_reduction_pct",
        "perc_rev_sla_d_ci_width", "perc_rev_sla_d_ci_reduction", "perc_rev_sla_d_ci_reduction_pct",
    )


def estimates(cells: DataFrame, goals: Sequence[str] = (fixed.OVERALL,)) -> DataFrame:
    """Point estimates with interval ends per cell."""
    kept = cells.where((F.col("direction") != UNCUT) & F.col("optimization_goal").isin(list(goals)))
    return kept.select(
        *CELL,
        "cali_d", "cali_d_lo", "cali_d_hi",
        "perc_rev_sla_d", "perc_rev_sla_d_lo", "perc_rev_sla_d_hi",
    )
