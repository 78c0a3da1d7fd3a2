"""Registered sequential-test queries over the role views.

Blocks are kept short here so that the tables of the tests span several.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sequential as op
from tidemark.plans.calibration_queries import rounded
from tidemark.sources import roles

EVERY = 100
STEPS = 256


def experiment_obs(spark, sf_dir):
    return op.numbered(roles.experiment_events(spark, sf_dir), ["ts", "event_id"])


def experiment_steps(spark, sf_dir):
    return rounded(experiment_obs(spark, sf_dir))


def expanding_moments(spark, sf_dir):
    moments = op.with_own_mean_spread(op.expanding_moments(experiment_obs(spark, sf_dir), STEPS))
    return rounded(
        moments.select("experiment_id", "step", "mean_c", "mean_t", "var_c", "var_t", "stdev_c", "stdev_t"), 7
    )


def peek_intervals(spark, sf_dir):
    return rounded(op.peek_intervals(experiment_obs(spark, sf_dir), EVERY, op.obrien_fleming_alpha, block_steps=STEPS), 7)


def peek_intervals_naive(spark, sf_dir):
    return rounded(op.peek_intervals(experiment_obs(spark, sf_dir), EVERY, op.naive_alpha, mu=0.0, block_steps=STEPS), 7)


def peek_performance(spark, sf_dir):
    found = op.peek_intervals(experiment_obs(spark, sf_dir), EVERY, op.bonferroni_alpha, mu=0.0, block_steps=STEPS)
    return rounded(op.peek_performance(found))


def peek_length(spark, sf_dir):
    found = op.peek_intervals(experiment_obs(spark, sf_dir), EVERY, op.naive_alpha, mu=0.0, block_steps=STEPS)
    return rounded(op.average_length(found))


def alpha_table(spark, sf_dir):
    sizes = op.experiment_sizes(roles.experiment_events(spark, sf_dir))
    return rounded(op.alpha_comparison(sizes, EVERY), 8)


def msprt_steps(spark, sf_dir):
    return rounded(op.msprt_steps(experiment_obs(spark, sf_dir), block_steps=STEPS), 7)


def msprt_readout(spark, sf_dir):
    return op.msprt_readout(op.msprt_steps(experiment_obs(spark, sf_dir), block_steps=STEPS))


def msprt_summary(spark, sf_dir):
    return rounded(op.msprt_summary(msprt_readout(spark, sf_dir)))


def msprt_by_step(spark, sf_dir):
    return rounded(op.decisions_by_step(op.msprt_steps(experiment_obs(spark, sf_dir), block_steps=STEPS)))


def sample_size(spark, sf_dir):
    obs = roles.experiment_events(spark, sf_dir)
    return rounded(op.sample_sizes(obs, ["experiment_id", "arm"]))


QUERIES = {
    f.__name__: f
    for f in (
        experiment_steps, expanding_moments, peek_intervals, peek_intervals_naive, peek_performance, peek_length,
        alpha_table, msprt_steps, msprt_readout, msprt_summary, msprt_by_step, sample_size,
    )
}
