"""Reading out running experiments: expanding moments, peeks with alpha spending, mSPRT.

Observations carry a dense step per experiment and arm. Steps are cut into
blocks of fixed length; a block is worked on in one task, and what earlier
blocks add up to is carried in, so an experiment of any length is spread over
the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.functions.alpha import (
    COLUMNS,
    bonferroni_alpha,
    naive_alpha,
    obrien_fleming_alpha,
    z_column,
    z_for,
)
from tidemark.operators import ordering
from tidemark.operators.ordering import BLOCK

EXPERIMENT = "experiment_id"
BLOCK_STEPS = 250_000
Policy = Callable[[int, int, Sequence[int]], float]


# --- alpha schedules ---------------------------------------------------------------


def with_alpha(peeks: DataFrame, every: int, policy: Policy) -> DataFrame:
    """Rows (peek, n, ...), one per peek of an experiment of n steps, with peek_window, last_peek, alpha and z.

    The policies of functions.alpha are column expressions. Any other Python
    callable (peek, n, peeks) runs on even batches of peeks; those of one
    experiment need not meet.
    """

    @F.pandas_udf("alpha double, z double")
    def spent(peek: pd.Series, n: pd.Series) -> pd.DataFrame:
        alphas = [policy(int(i), int(m), range(every, int(m) + 1, every)) for i, m in zip(peek, n)]
        return pd.DataFrame({"alpha": alphas, "z": [z_for(a) for a in alphas]})

    if policy in COLUMNS:
        alpha = COLUMNS[policy](F.col("peek"), F.col("n"), F.floor(F.col("n") / every))
        found = peeks.withColumn("alpha", alpha).withColumn("z", z_column(F.col("alpha")))
    else:
        found = peeks.withColumn("_spent", spent(F.col("peek"), F.col("n"))).withColumns(
            {"alpha": F.col("_spent.alpha"), "z": F.col("_spent.z")}
        )
    return found.withColumns(
        {
            "peek_window": (F.col("peek") / every).cast("long"),
            "last_peek": (F.col("n") - F.col("n") % every).cast("long"),
        }
    ).drop("_spent")


def alpha_schedule(sizes: DataFrame, every: int, policy: Policy) -> DataFrame:
    """Peeks of each experiment (experiment_id, n) with their alpha and z."""
    long_enough = sizes.select(EXPERIMENT, "n").where(F.col("n") >= every)
    steps = F.sequence(F.lit(every).cast("long"), F.col("n").cast("long"), F.lit(every).cast("long"))
    return with_alpha(long_enough.withColumn("peek", F.explode(steps)), every, policy)


def alpha_comparison(sizes: DataFrame, every: int) -> DataFrame:
    """Bonferroni and O'Brien-Fleming alpha side by side per peek."""
    first = alpha_schedule(sizes, every, bonferroni_alpha).withColumnRenamed("alpha", "bonferroni_correction")
    both = with_alpha(first.drop("z"), every, obrien_fleming_alpha)
    return both.select(
        EXPERIMENT, "peek", "peek_window", "bonferroni_correction", F.col("alpha").alias("obrien_fleming")
    )


# --- expanding moments --------------------------------------------------------------


def numbered(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Give observations their step within experiment and arm."""
    return ordering.row_numbers(events.where(F.col(EXPERIMENT).isNotNull()), [EXPERIMENT, "arm"], order, "step").select(
        EXPERIMENT, "arm", "step", "x"
    )


def paired(obs: DataFrame, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Both arms of a step in one row, in blocks of steps; a step may lack an arm."""
    block = F.floor((F.col("step") - 1) / F.lit(block_steps)).cast("long")
    placed = obs.withColumn(BLOCK, block).repartition(EXPERIMENT, BLOCK)

    def arm(name: str) -> Column:
        return F.max(F.when(F.col("arm") == name, F.col("x").cast("double")))

    return placed.groupBy(EXPERIMENT, BLOCK, "step").agg(
        arm("control").alias("x_c"), arm("treatment").alias("x_t")
    )


def expanding_moments(obs: DataFrame, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Running mean and sample variance per arm at each step that both arms have reached.

    Sums are kept around the mean of the whole experiment, so large values do
    not cancel. full_c and full_t are the sizes of the arms, n the paired steps.
    """
    rows = paired(obs, block_steps)
    both = F.col("x_c").isNotNull() & F.col("x_t").isNotNull()
    parts = rows.groupBy(EXPERIMENT, BLOCK).agg(
        F.count("x_c").alias("_all_c"),
        F.count("x_t").alias("_all_t"),
        F.count(F.when(both, 1)).alias("_n"),
        *[F.coalesce(F.avg(F.when(both, F.col(f"x_{a}"))), F.lit(0.0)).alias(f"_m_{a}") for a in "ct"],
        *[F.coalesce(F.var_pop(F.when(both, F.col(f"x_{a}"))), F.lit(0.0)).alias(f"_v_{a}") for a in "ct"],
    )
    # One row per block of an experiment in these windows.
    whole = Window.partitionBy(EXPERIMENT)
    earlier = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    def before(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    n = F.col("_n")
    carry = parts.withColumns(
        {
            "n": F.sum("_n").over(whole),
            "full_c": F.sum("_all_c").over(whole),
            "full_t": F.sum("_all_t").over(whole),
            "_before": before(n),
            **{
                f"_center_{a}": F.try_divide(F.sum(n * F.col(f"_m_{a}")).over(whole), F.sum(n).over(whole))
                for a in "ct"
            },
        }
    )
    off = {a: F.col(f"_m_{a}") - F.col(f"_center_{a}") for a in "ct"}
    carry = carry.withColumns(
        {
            **{f"_s_{a}": before(n * off[a]) for a in "ct"},
            **{f"_q_{a}": before(n * (F.col(f"_v_{a}") + off[a] * off[a])) for a in "ct"},
        }
    ).drop("_all_c", "_all_t", "_n", "_m_c", "_m_t", "_v_c", "_v_t")
    inside = (
        Window.partitionBy(EXPERIMENT, BLOCK).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = rows.where(both).join(carry, [EXPERIMENT, BLOCK])
    count = F.col("_before") + F.row_number().over(inside)
    columns = {}
    for a in "ct":
        centered = F.col(f"x_{a}") - F.col(f"_center_{a}")
        total = F.col(f"_s_{a}") + F.sum(centered).over(inside)
        squares = F.col(f"_q_{a}") + F.sum(centered * centered).over(inside)
        columns[f"mean_{a}"] = F.col(f"_center_{a}") + total / count
        columns[f"var_{a}"] = F.when(
            count > 1, F.greatest(F.try_divide(squares - total * total / count, count - 1), F.lit(0.0))
        )
    return joined.withColumns(columns).select(
        EXPERIMENT, BLOCK, "step", "n", "full_c", "full_t", "x_c", "x_t", *columns
    )


def with_own_mean_spread(moments: DataFrame) -> DataFrame:
    """Add stdev per arm: root of the mean squared distance of each value to its own running mean."""
    squared = {
        f"_d_{a}": F.pow(F.col(f"x_{a}") - F.col(f"mean_{a}"), F.lit(2.0)) for a in "ct"
    }
    summed = ordering.running(moments, [EXPERIMENT], ["step"], squared)
    return summed.withColumns(
        {f"stdev_{a}": F.sqrt(F.col(f"_d_{a}") / F.col("step")) for a in "ct"}
    ).drop("_d_c", "_d_t")


def experiment_sizes(events: DataFrame) -> DataFrame:
    """Steps that both arms reach, from counts per arm."""
    arm = lambda name: F.count(F.when(F.col("arm") == name, 1))
    counted = events.where(F.col(EXPERIMENT).isNotNull()).groupBy(EXPERIMENT)
    return counted.agg(F.least(arm("control"), arm("treatment")).alias("n"))


# --- peeks ----------------------------------------------------------------------------


def peek_intervals(
    obs: DataFrame, every: int, policy: Policy, mu: float = 1.0, block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Interval of the mean difference at each peek, with coverage of mu and sticky decisions.

    Only peek steps go on from the running values; what sticks is the first
    peek of its kind, one number per experiment.
    """
    moments = with_own_mean_spread(expanding_moments(obs, block_steps))
    peeks = moments.where(F.col("step") % every == 0).withColumn("peek", F.col("step").cast("long"))
    peeks = with_alpha(peeks, every, policy)
    spread = F.sqrt(F.pow("stdev_c", F.lit(2.0)) + F.pow("stdev_t", F.lit(2.0)))
    bounded = (
        peeks.withColumns(
            {
                "mean_diff": F.col("mean_t") - F.col("mean_c"),
                "width": F.col("z") * spread / F.sqrt(F.col("peek")),
            }
        )
        .withColumns(
            {"lower": F.col("mean_diff") - F.col("width"), "upper": F.col("mean_diff") + F.col("width")}
        )
        .withColumns(
            {
                "coverage": ((F.col("lower") <= mu) & (F.col("upper") >= mu)).cast("int"),
                "_rejects": ((F.col("lower") >= 0) | (F.col("upper") <= 0)).cast("int"),
            }
        )
    )
    bounded = ordering.settle(bounded)
    firsts = bounded.groupBy(EXPERIMENT).agg(
        F.min(F.when(F.col("_rejects") == 1, F.col("peek"))).alias("_rejected"),
        F.min(F.when(F.col("coverage") == 0, F.col("peek"))).alias("_missed"),
    )
    since = lambda first: F.coalesce(F.col("peek") >= F.col(first), F.lit(False))
    return bounded.join(firsts, EXPERIMENT).select(
        EXPERIMENT, "peek_window", "peek", "alpha", "mean_diff", "width", "lower", "upper", "coverage",
        since("_rejected").cast("int").alias("power"),
        since("_missed").cast("int").alias("falsepos"),
        F.when(since("_rejected"), F.col("_rejected")).otherwise(F.col("last_peek")).alias("length"),
    )


def peek_performance(intervals: DataFrame) -> DataFrame:
    """Shares over experiments per peek."""
    return intervals.groupBy("peek").agg(
        *[F.avg(c).alias(c) for c in ("coverage", "power", "falsepos")], F.count("*").alias("experiments")
    )


def average_length(intervals: DataFrame) -> DataFrame:
    """Mean over experiments of the peek at which they could stop."""
    last = intervals.groupBy(EXPERIMENT).agg(F.max_by("length", "peek").alias("length"))
    return last.agg(F.avg("length").alias("average_length"))


# --- mSPRT ------------------------------------------------------------------------------


def msprt_steps(obs: DataFrame, alpha: float = 0.05, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Mixture sequential test at each step from the second on.

    A step without variance has no decision. decision_so_far and length follow
    from the first rejecting step, which is one number per experiment.
    """
    moments = expanding_moments(obs, block_steps).where(F.col("step") >= 2)
    z2 = F.lit(normal.two_sided_z(100 * (1 - alpha)) ** 2)
    v = F.col("var_c") / F.col("step") + F.col("var_t") / F.col("step")
    tau = z2 * (F.col("var_c") / F.col("full_c") + F.col("var_t") / F.col("full_t"))
    known = F.col("_v") > 0
    share = F.try_divide(F.col("_v"), F.col("_v") + F.col("tau"))
    half = F.sqrt(F.try_divide(F.col("_v") * (F.col("_v") + F.col("tau")), F.col("tau"))) * F.sqrt(
        F.lit(-2.0 * math.log(alpha)) - F.log(share)
    )
    decided = (
        moments.withColumns({"_v": v, "tau": tau, "delta": F.col("mean_t") - F.col("mean_c")})
        .withColumn("ci", F.when(known, half))
        .withColumn("decision", (F.abs("delta") > F.col("ci")).cast("int"))
        .select(EXPERIMENT, BLOCK, "step", "delta", "tau", "ci", "decision", "full_t")
    )
    parts = decided.groupBy(EXPERIMENT, BLOCK).agg(
        F.min(F.when(F.col("decision") == 1, F.col("step"))).alias("_first")
    )
    first = parts.select(
        EXPERIMENT, BLOCK, F.min("_first").over(Window.partitionBy(EXPERIMENT)).alias("first_reject")
    )
    reached = F.coalesce(F.col("step") >= F.col("first_reject"), F.lit(False))
    return decided.join(first, [EXPERIMENT, BLOCK]).select(
        EXPERIMENT, "step", "delta", "tau", "ci", "decision",
        reached.cast("int").alias("decision_so_far"),
        F.when(reached, F.col("first_reject")).otherwise(F.col("full_t")).alias("length"),
    )


def msprt_readout(steps: DataFrame) -> DataFrame:
    """Rejected or not, and stopping length, per experiment."""
    return steps.groupBy(EXPERIMENT).agg(
        F.max("decision_so_far").alias("rejected"), F.min("length").alias("length"), F.max("step").alias("steps")
    )


def msprt_summary(readout: DataFrame) -> DataFrame:
    """Share of experiments that rejected (power, or false positives under no effect), mean length."""
    return readout.agg(
        F.count("*").alias("experiments"),
        F.avg("rejected").alias("rejected_share"),
        F.avg("length").alias("average_length"),
    )


def decisions_by_step(steps: DataFrame) -> DataFrame:
    """Share of experiments that have rejected by each step."""
    return steps.groupBy("step").agg(F.avg("decision_so_far").alias("result"))


# --- planning ---------------------------------------------------------------------------


def sample_sizes(
    obs: DataFrame, by: Sequence[str] = (EXPERIMENT,), mde: float = 1.0, alpha: float = 0.05, beta: float = 0.2
) -> DataFrame:
    """Smallest sample size per segment for the spread seen in the data."""
    reach = normal.quantile(1 - alpha / 2) + normal.quantile(1 - beta)
    return obs.groupBy(*by).agg(F.stddev_samp("x").alias("sigma")).withColumn(
        "sample_size", F.floor(F.pow(F.lit(2.0 * reach / mde) * F.col("sigma"), F.lit(2.0)))
    )
