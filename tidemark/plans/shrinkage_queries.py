"""Registered shrinkage and A/A queries over the role views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calibration
from tidemark.operators import shrinkage as op
from tidemark.plans.calibration_queries import rounded
from tidemark.sources import roles


def _population(spark, sf_dir):
    return calibration.line_items(roles.served_items(spark, sf_dir))


def _sampled(spark, sf_dir):
    """Simulations, with priors from one goal's traffic, so that some items have none."""
    return calibration.line_items(roles.served_items(spark, sf_dir), by_sim=True)


def _goal_priors(spark, sf_dir):
    return op.priors(calibration.line_items(roles.served_items(spark, sf_dir), goal="APP_INSTALLS"))


def priors(spark, sf_dir):
    return rounded(op.priors(_population(spark, sf_dir)))


def posteriors(spark, sf_dir):
    found = op.posteriors(_sampled(spark, sf_dir), _goal_priors(spark, sf_dir))
    found = found.withColumn("rev_sla_li", F.round("rev_sla_li", 2))
    return rounded(found.select("sim_id", "line_item_id", "post_sla_li", "rev_sla_li", "prior_p"), 8)


def _sims(spark, sf_dir):
    return op.posterior_totals(op.posteriors(_sampled(spark, sf_dir), _goal_priors(spark, sf_dir)))


def posterior_totals(spark, sf_dir):
    return rounded(_sims(spark, sf_dir))


def posterior_population(spark, sf_dir):
    items = _population(spark, sf_dir)
    return rounded(op.posterior_totals(op.posteriors(items, op.priors(items)), by=()))


def posterior_summary(spark, sf_dir):
    return rounded(op.metric_summary(_sims(spark, sf_dir), ["pct_rev_sla", "pct_rev_sla_li"]), 8)


def variance_reduction(spark, sf_dir):
    return rounded(op.variance_reduction(_sims(spark, sf_dir)), 8)


def overdispersion(spark, sf_dir):
    return rounded(op.overdispersion(_population(spark, sf_dir)), 8)


def prior_strength(spark, sf_dir):
    return rounded(op.prior_strength(_population(spark, sf_dir)), 8)


def conversion_buckets(spark, sf_dir):
    return rounded(op.bucket_stats(_sampled(spark, sf_dir)))


def id_overlap(spark, sf_dir):
    return rounded(op.id_overlap(roles.aa_wide(spark, sf_dir), _goal_priors(spark, sf_dir)))


def aa_frame(spark, sf_dir):
    return rounded(op.aa_frame(roles.aa_wide(spark, sf_dir)))


def aa_normal(spark, sf_dir):
    return rounded(op.aa_normal(op.aa_frame(roles.aa_wide(spark, sf_dir)), op.priors(_population(spark, sf_dir))), 8)


def aa_normal_verdict(spark, sf_dir):
    sims = op.aa_normal(op.aa_frame(roles.aa_wide(spark, sf_dir)), op.priors(_population(spark, sf_dir)))
    return rounded(op.aa_verdict(sims))


def _drawn(spark, sf_dir):
    frame, prior = op.aa_frame(roles.aa_wide(spark, sf_dir)), op.priors(_population(spark, sf_dir))
    return op.aa_agreement(op.aa_beta(frame, prior, samples=300), op.aa_normal(frame, prior))


def aa_beta(spark, sf_dir):
    return _drawn(spark, sf_dir)


def aa_beta_verdict(spark, sf_dir):
    """Over all simulations: the drawn false positives, their rate and verdict, and those that the normal check allows."""
    frame = op.known_aa_frame(roles.aa_wide(spark, sf_dir), op.priors(_population(spark, sf_dir)))
    drawn = op.aa_beta(frame, None, samples=300, draws=op.hashed_draws, drawn_at_once=256)
    return rounded(op.aa_bounds(drawn, op.aa_normal(frame, None)))


QUERIES = {
    f.__name__: f
    for f in (
        priors, posteriors, posterior_totals, posterior_population, posterior_summary, variance_reduction,
        overdispersion, prior_strength, conversion_buckets, id_overlap, aa_frame, aa_normal, aa_normal_verdict,
        aa_beta, aa_beta_verdict,
    )
}
