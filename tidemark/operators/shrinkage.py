"""Empirical-Bayes shrinkage of the band flag, its diagnosis, and A/A checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import normal
from tidemark.functions import numbers as num
from tidemark.operators import calibration

TINY = 1e-6
ITEM = "line_item_id"
_DRAWN_AT_ONCE = 4_096
_MICRO = 1e6
# Sums that a task keeps, and how large all of them may become together: they are 64-bit integers.
_MOST_SUMS, _MOST_MICRO = 2_097_152, 2.0**62


def priors(items: DataFrame, flag: str = "sla_flag", weight: str = "conversions") -> DataFrame:
    """A Beta prior per line item from its own flag, with the root of its conversions as strength."""
    p = num.clip(F.col(flag).cast("double"), TINY, 1 - TINY)
    strength = F.sqrt(F.greatest(F.col(weight).cast("double"), F.lit(TINY)))
    return items.select(
        ITEM, (p * strength).alias("alpha"), ((F.lit(1.0) - p) * strength).alias("beta")
    )


def _posterior() -> dict[str, Column]:
    n = F.sqrt(F.col("conversions").cast("double"))
    k = F.col("sla_flag") * n
    return {"alpha_post": F.col("alpha") + k, "beta_post": F.col("beta") + n - k}


def posteriors(items: DataFrame, prior: DataFrame) -> DataFrame:
    """Posterior band rate and its revenue; NULL for items without a prior."""
    found = items.join(prior, ITEM, "left").withColumns(_posterior())
    rate = num.ratio(F.col("alpha_post"), F.col("alpha_post") + F.col("beta_post"))
    return (
        found.withColumn("post_sla_li", rate)
        .withColumns(
            {
                "rev_sla_li": F.col("post_sla_li") * F.col("revenue"),
                "prior_p": num.ratio(F.col("alpha"), F.col("alpha") + F.col("beta")),
            }
        )
        .drop("alpha", "beta", "alpha_post", "beta_post")
    )


def posterior_totals(found: DataFrame, by: Sequence[str] = ("sim_id",)) -> DataFrame:
    """Totals and shares, raw and shrunk, per simulation or (by=()) overall."""
    sums = ("revenue", "conversions", "conversions_pred", "rev_sla", "rev_sla_li")
    rolled = calibration.keyed(found, by).groupBy(*by).agg(
        *[calibration.total(c).alias(c) for c in sums], F.avg("sla_flag").alias("avg_sla_rate")
    )
    ratio = F.when(F.col("conversions") > 0, num.ratio(F.col("conversions_pred"), F.col("conversions")))
    return rolled.select(
        *by,
        "revenue",
        "conversions",
        "conversions_pred",
        F.coalesce(ratio, F.lit(0.0)).alias("calibration"),
        "avg_sla_rate",
        num.ratio(F.col("rev_sla"), F.col("revenue")).alias("pct_rev_sla"),
        num.ratio(F.col("rev_sla_li"), F.col("revenue")).alias("pct_rev_sla_li"),
    )


def metric_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, standard deviation, least and greatest value, one row per metric."""
    lines = [
        F.struct(
            F.lit(m).alias("metric"),
            F.avg(m).alias("mean"),
            F.stddev_samp(m).alias("std"),
            F.min(m).alias("min"),
            F.max(m).alias("max"),
        )
        for m in metrics
    ]
    return df.agg(F.array(*lines).alias("_lines")).select(F.inline("_lines"))


def variance_reduction(sims: DataFrame, raw: str = "pct_rev_sla", shrunk: str = "pct_rev_sla_li") -> DataFrame:
    """How much smaller the variance over simulations is after shrinking, in percent."""
    lost = F.lit(1.0) - num.ratio(F.var_samp(shrunk), F.var_samp(raw))
    return sims.agg(
        F.var_samp(raw).alias("raw_var"),
        F.var_samp(shrunk).alias("shrunk_var"),
        (lost * F.lit(100.0)).alias("variance_reduction_pct"),
    )


# --- diagnosis -----------------------------------------------------------------------


def overdispersion(items: DataFrame, count: str = "conversions", flag: str = "sla_flag") -> DataFrame:
    """Spread of counts and flags against Poisson and Bernoulli, moments of the ratio, one row.

    Count variance is the population one, the others are sample variances.
    """
    counted, rate = F.col(count).cast("double"), F.avg(F.col(flag).cast("double"))
    ratio = F.when(counted > 0, num.ratio(F.col("conversions_pred"), counted))
    mean, spread = F.avg(counted), F.var_pop(counted)
    return items.agg(
        mean.alias("count_mean"),
        spread.alias("count_var"),
        F.try_divide(spread, mean).alias("count_dispersion"),
        rate.alias("flag_rate"),
        F.try_divide(F.var_samp(F.col(flag).cast("double")), rate * (F.lit(1.0) - rate)).alias(
            "binary_dispersion"
        ),
        F.count(ratio).alias("rows_with_conversions"),
        F.avg(ratio).alias("calib_mean"),
        F.var_samp(ratio).alias("calib_var"),
        F.stddev_samp(ratio).alias("calib_std"),
        F.try_divide(F.stddev_samp(ratio), F.avg(ratio)).alias("calib_cv"),
        F.when(spread > mean, F.try_divide(mean * mean, spread - mean)).alias("negbin_r"),
    )


def prior_strength(
    items: DataFrame, flag: str = "sla_flag", weight: str = "conversions", sizes: Sequence[int] = (10, 100)
) -> DataFrame:
    """Weighted rate, its variance, the prior strength nu they imply, and shrinkage weights, one row.

    The variance around the (clipped) rate follows from weighted sums, in one pass.
    """
    x = F.col(flag).cast("double")
    w = F.sqrt(F.col(weight).cast("double") + F.lit(TINY))
    sums = items.agg(
        F.sum(w).alias("_w"), F.sum(w * x).alias("_wx"), F.sum(w * x * x).alias("_wxx"),
        F.corr(x, F.col(weight).cast("double")).alias("correlation"),
    )
    first, second = num.ratio(F.col("_wx"), F.col("_w")), num.ratio(F.col("_wxx"), F.col("_w"))
    p, v, most = F.col("p_bar"), F.col("v_bar"), F.col("max_v")
    measured = (
        sums.withColumn("p_bar", num.clip(first, TINY, 1 - TINY))
        .withColumns({"v_bar": second - F.lit(2.0) * p * first + p * p, "max_v": p * (F.lit(1.0) - p)})
        .withColumns(
            {"variance_ratio": F.try_divide(v, most), "nu_est": F.try_divide(most, v) - F.lit(1.0)}
        )
    )
    weights = {f"data_weight_{n}": F.try_divide(F.lit(float(n)), F.lit(float(n)) + F.col("nu_est")) for n in sizes}
    weights |= {f"prior_weight_{n}": F.lit(1.0) - weights[f"data_weight_{n}"] for n in sizes}
    return measured.withColumns(weights).drop("_w", "_wx", "_wxx")


def conversion_bucket(value: Column) -> Column:
    """Right-closed bucket; values of zero and below fall in none."""
    label = None
    for low, high, name in fixed.CONVERSION_BUCKETS:
        test = value > low if high is None else (value > low) & (value <= high)
        label = F.when(test, name) if label is None else label.when(test, name)
    return label


def bucket_stats(items: DataFrame, flag: str = "sla_flag", weight: str = "conversions") -> DataFrame:
    """Rate, spread and size by conversion bucket, half-even to four places."""
    return (
        items.withColumn("conv_bucket", conversion_bucket(F.col(weight)))
        .where(F.col("conv_bucket").isNotNull())
        .groupBy("conv_bucket")
        .agg(
            num.half_even(F.avg(flag), 4).alias("mean_sla"),
            num.half_even(F.stddev_samp(flag), 4).alias("std_sla"),
            F.count(flag).alias("n_items"),
        )
    )


def id_overlap(left: DataFrame, right: DataFrame, key: str = ITEM) -> DataFrame:
    """Distinct keys on the left, how many the right knows, and the ratio."""
    known = right.select(key).distinct().withColumn("_known", F.lit(1))
    both = left.select(key).distinct().join(known, key, "left")
    return both.agg(F.count("*").alias("ids"), F.count("_known").alias("overlap")).withColumn(
        "overlap_ratio", num.ratio(F.col("overlap"), F.col("ids"))
    )


# --- A/A checks ------------------------------------------------------------------------


def aa_frame(wide: DataFrame, arms: Sequence[str] = ("a1", "a2"), keep: Sequence[str] = ()) -> DataFrame:
    """Arms of an A/A split from side by side to one row per simulation, item and arm, with the columns to keep."""
    lines = [
        F.struct(
            F.lit(a).alias("arm"),
            F.col(f"conv_{a}").alias("conversions"),
            F.col(f"pred_conv_{a}").alias("conversions_pred"),
            F.col(f"rev_{a}").alias("revenue"),
        )
        for a in arms
    ]
    stacked = wide.select(F.col("iteration_id").alias("sim_id"), ITEM, *keep, F.inline(F.array(*lines)))
    return calibration.with_sla(stacked)


def known_aa_frame(wide: DataFrame, prior: DataFrame, arms: Sequence[str] = ("a1", "a2")) -> DataFrame:
    """aa_frame of the items with a prior, and that prior: joined side by side, where there are half the rows.

    Checks of the same frame share its shuffle.
    """
    return aa_frame(wide.join(prior, ITEM), arms, keep=("alpha", "beta"))


def _with_known_prior(frame: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Items without a prior are left out (id_overlap tells how many), and rows of no simulation.

    None: the frame has its prior (known_aa_frame).
    """
    known = calibration.keyed(frame, ["sim_id"])
    return (known if prior is None else known.join(prior, ITEM)).withColumns(_posterior())


def aa_normal(frame: DataFrame, prior: DataFrame | None, confidence: float = 95) -> DataFrame:
    """Per simulation: revenue-weighted posterior means of both arms and whether they differ.

    The weighted sum of independent Beta rates is taken as normal, with mean
    and variance from sums alone.
    """
    a, b, r = F.col("alpha_post"), F.col("beta_post"), F.col("revenue").cast("double")
    mean = F.try_divide(a, a + b)
    variance = F.try_divide(a * b, (a + b) * (a + b) * (a + b + 1))
    arms = (
        _with_known_prior(frame, prior)
        .groupBy("sim_id", "arm")
        .agg(
            num.ratio(F.sum(r * mean), F.sum(r)).alias("_mu"),
            num.ratio(F.sum(r * r * variance), F.sum(r) * F.sum(r)).alias("_var"),
        )
    )

    def of(arm: str, column: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(column)))

    z = F.try_divide(F.col("mu_a2") - F.col("mu_a1"), F.sqrt(F.col("var_a1") + F.col("var_a2")))
    return (
        arms.groupBy("sim_id")
        .agg(*[of(arm, f"_{c}").alias(f"{c}_{arm}") for c in ("mu", "var") for arm in ("a1", "a2")])
        .withColumn("z", z)
        .withColumn(
            "false_positive",
            F.coalesce(F.abs("z") > normal.two_sided_z(confidence), F.lit(False)).cast("int"),
        )
    )


def aa_verdict(sims: DataFrame, bound: float = 0.05) -> DataFrame:
    """False positives over simulations and whether their rate stays in bounds."""
    return sims.agg(
        F.sum("false_positive").alias("false_positives"),
        F.count("*").alias("simulations"),
        F.avg("false_positive").alias("fp_rate"),
    ).withColumn("verdict", F.when(F.col("fp_rate") <= bound, "SAFE").otherwise("NOISY"))


def beta_draws(seed: int, sim_id: int, arm: str, item: str, a: float, b: float, samples: int) -> np.ndarray:
    """Draws of one row: a counter-based stream that its key alone determines, wherever the row is worked on."""
    key = hashlib.blake2b(f"{seed}|{sim_id}|{arm}|{item}".encode(), digest_size=16).digest()
    stream = np.random.Generator(np.random.Philox(key=np.frombuffer(key, dtype=np.uint64)))
    return stream.beta(a, b, samples)


def stream_draws(rows: pd.DataFrame, seed: int, samples: int) -> np.ndarray:
    """beta_draws of every row: one line of draws each."""
    return np.stack(
        [beta_draws(seed, r.sim_id, r.arm, r.item, r.alpha_post, r.beta_post, samples) for r in rows.itertuples(index=False)]
    )


#: Tries of a gamma draw; each is taken with a chance of 0.95 or more.
GAMMA_TRIES = 8
_SLOTS = 3 * GAMMA_TRIES + 1
_WEYL = 0x9E3779B9


def _uniforms(counters: np.ndarray, keys: np.ndarray, slot: int) -> np.ndarray:
    """Between 0 and 1, from a 32-bit integer hash of key and counter; products wrap."""
    x = (counters + np.uint32(slot * _WEYL % 2**32)) ^ keys
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return (x + 0.5) / 2.0**32


def _log_gamma_draws(shape: np.ndarray, keys: np.ndarray, samples: int, first: int) -> np.ndarray:
    """Logarithms of gamma draws by Marsaglia and Tsang, a line per shape; first is the slot of a line's first uniform."""
    slots = (np.arange(samples) * 2 * _SLOTS + first) * _WEYL % 2**32
    counters, masks = keys[:, :1] + slots.astype(np.uint32), keys[:, 1:]
    d = (np.where(shape < 1, shape + 1, shape) - 1 / 3)[:, None]
    found = np.zeros(counters.shape)
    # All draws first, then those that are not yet taken.
    at: tuple = (slice(None),)
    for attempt in range(GAMMA_TRIES):
        here, own, scale = counters[at], masks[at[0]], d[at[0]]
        if attempt:
            own, scale = own[:, 0], scale[:, 0]
        u, turn, w = (_uniforms(here, own, 3 * attempt + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * turn)
        v = 1 + x / np.sqrt(9 * scale)
        log_v = 3 * np.log(np.maximum(v, 1e-300))
        taken = (v > 0) & (np.log(w) < x * x / 2 + scale * (1 - v * v * v + log_v))
        found[at] = np.where(taken, log_v, 0)
        at = np.nonzero(~taken) if attempt == 0 else tuple(i[~taken] for i in at)
        if not len(at[0]):
            break
    found += np.log(d)
    small = np.flatnonzero(shape < 1)
    found[small] += np.log(_uniforms(counters[small], masks[small], 3 * GAMMA_TRIES)) / shape[small, None]
    return found


def _hash_keys(rows: pd.DataFrame, seed: int) -> np.ndarray:
    """Two 32-bit integers per row, from the md5 of its key; the column key has its bytes where Spark made them."""
    if "key" in rows:
        found = rows["key"]
    else:
        texts = (f"{seed}|{r.sim_id}|{r.arm}|{r.item}" for r in rows.itertuples(index=False))
        found = (hashlib.md5(t.encode()).digest()[:8] for t in texts)
    return np.frombuffer(b"".join(found), dtype=">u4").astype(np.uint32).reshape(-1, 2)


def _shapes(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both shapes, 1 where one of them is not known, and whether both are."""
    a, b = (rows[c].to_numpy(dtype=float) for c in ("alpha_post", "beta_post"))
    if (a <= 0).any() or (b <= 0).any():
        raise ValueError("alpha_post or beta_post is 0 or less")
    known = ~(np.isnan(a) | np.isnan(b))
    return np.where(known, a, 1.0), np.where(known, b, 1.0), known


def _beta_of_logs(log_x: np.ndarray, log_y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(log_y - log_x, 700)))


def hashed_draws(rows: pd.DataFrame, seed: int, samples: int) -> np.ndarray:
    """Beta draws from integer hashes of each row's key and a counter: any engine with md5 can repeat them.

    Rows without a posterior draw 0, so that they add as little as in aa_normal.
    """
    a, b, known = _shapes(rows)
    keys = _hash_keys(rows, seed)
    log_x, log_y = _log_gamma_draws(a, keys, samples, 0), _log_gamma_draws(b, keys, samples, _SLOTS)
    return known[:, None] * _beta_of_logs(log_x, log_y)


# Sums of these draws without most of their logarithms: arrays that stay in the processor's cache, written in place.
_LINES, _LIGHT_LINES, _PENDING = 64, 128, 32_768
# The sine of a turn of a quarter at most by its series, to 1e-16.
_SINE = [(-1) ** k * (2 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(11)]
# No normal draw is beyond 6.77, no logarithm of a uniform below -22.88: they have 32 bits.
_MOST_NORMAL, _LEAST_LOG = 6.77, -22.88


def _steps(samples: int, slot: int) -> np.ndarray:
    return ((np.arange(samples) * 2 * _SLOTS + slot) * _WEYL % 2**32).astype(np.uint32)


def _mix(keys: np.ndarray, steps: np.ndarray, x: np.ndarray, spare: np.ndarray) -> None:
    """The hash of _uniforms into x, a line per key."""
    np.add(keys[:, :1], steps, out=x)
    np.bitwise_xor(x, keys[:, 1:], out=x)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor is not None:
            np.multiply(x, np.uint32(factor), out=x)


def _single(keys: np.ndarray, steps: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys of single draws, at lines and places, as if each were the first of a line of its own."""
    lines, places = at
    return np.stack([keys[lines, 0] + steps[places], keys[lines, 1]], axis=1)


class _Gammas:
    """First tries of _log_gamma_draws for shapes of 1 and more, not as logarithms, and the places of those not taken.

    Its arrays are used again by the next call.
    """

    def __init__(self, lines: int, samples: int):
        self.steps = [_steps(samples, slot) for slot in range(3)]
        self.integers = [np.empty((lines, samples), dtype=np.uint32) for _ in range(2)]
        self.doubles = [np.empty((lines, samples)) for _ in range(5)]

    def __call__(self, shape: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, spare = (i[: len(shape)] for i in self.integers)
        x, turn, series, v, w = (i[: len(shape)] for i in self.doubles)
        d = (shape - 1 / 3)[:, None]

        def uniform(slot: int, out: np.ndarray) -> None:
            _mix(keys, self.steps[slot], bits, spare)
            np.add(bits, 0.5, out=out)
            np.multiply(out, 2.0**-32, out=out)

        uniform(0, x)
        np.log(x, out=x)
        np.multiply(x, -2.0, out=x)
        np.sqrt(x, out=x)
        # cos(2 pi t) = sin(2 pi (|t - 1/2| - 1/4))
        uniform(1, turn)
        np.subtract(turn, 0.5, out=turn)
        np.abs(turn, out=turn)
        np.subtract(turn, 0.25, out=turn)
        np.multiply(turn, turn, out=v)
        np.multiply(v, _SINE[-1], out=series)
        for term in _SINE[-2:0:-1]:
            np.add(series, term, out=series)
            np.multiply(series, v, out=series)
        np.add(series, _SINE[0], out=series)
        np.multiply(series, turn, out=series)
        np.multiply(x, series, out=x)
        np.multiply(x, 1 / np.sqrt(9 * d), out=v)
        np.add(v, 1.0, out=v)
        uniform(2, w)
        # Marsaglia and Tsang's squeeze takes nine of ten draws as the logarithms would.
        np.multiply(x, x, out=turn)
        np.multiply(turn, turn, out=series)
        np.multiply(series, 0.0331, out=series)
        np.add(series, w, out=series)
        at = np.flatnonzero((series >= 1) | (v <= 0))
        own, scale = v.ravel()[at], d[at // v.shape[1], 0]
        log_v = 3 * np.log(np.maximum(own, 1e-300))
        taken = (own > 0) & (np.log(w.ravel()[at]) < turn.ravel()[at] / 2 + scale * (1 - own * own * own + log_v))
        np.multiply(v, v, out=series)
        np.multiply(series, v, out=series)
        np.multiply(series, d, out=series)
        return series, at[~taken]


def _micro(drawn: np.ndarray, revenue: np.ndarray) -> np.ndarray:
    return np.rint(drawn * revenue * _MICRO).astype(np.int64)


def _sum_lines(totals: np.ndarray, codes: np.ndarray, micro: np.ndarray) -> None:
    """Adds lines to the totals of their codes, which ascend."""
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    totals[codes[starts]] += np.add.reduceat(micro, starts, axis=0)


def drawn_sums(
    rows: pd.DataFrame, codes: np.ndarray, totals: np.ndarray, seed: int, held: int, draws: Callable[[pd.DataFrame, int, int], np.ndarray]
) -> None:
    """Adds the draws of rows, weighted by revenue, in millionths to the totals of their codes, which ascend."""
    for start in range(0, len(rows), held):
        part = rows.iloc[start : start + held]
        micro = _micro(draws(part, seed, totals.shape[1]), part["revenue"].to_numpy()[:, None])
        _sum_lines(totals, codes[start : start + held], micro)


def hashed_sums(rows: pd.DataFrame, codes: np.ndarray, totals: np.ndarray, seed: int, held: int) -> None:
    """drawn_sums of hashed_draws, in a small part of the time.

    A gamma draw of a shape s below 1 is one of s + 1 times w ** (1 / s) for a uniform w. Where s is tiny (a prior from a
    flag has one such shape) that is next to nothing unless w is next to 1, and the Beta draw adds nothing, or all of the
    revenue, to the last millionth. From the least and greatest logarithms of the other factors follows a bound for w
    up to which that is certain; each draw's w is compared with it, and draws beyond are worked out as hashed_draws does.
    """
    samples = totals.shape[1]
    a, b, known = _shapes(rows)
    keys, revenue = _hash_keys(rows, seed), rows["revenue"].to_numpy()
    small, large, whole = np.minimum(a, b), np.maximum(a, b), b < a
    shifted, other = small + 2 / 3, np.where(large < 1, large + 1, large) - 1 / 3
    most = np.log(shifted) + 3 * np.log1p(_MOST_NORMAL / np.sqrt(9 * shifted))
    least = np.log(other) + 2 * _LEAST_LOG / other - 1 + np.where(large < 1, _LEAST_LOG / large, 0)
    # 1 / (1 + exp(-38)) is 1; a share below exp(-clear) of the revenue is less than half a millionth.
    clear = np.where(whole, 38.0, np.log(np.maximum(np.abs(revenue) * _MICRO / 0.4, 1.0))) + 1
    reach = np.maximum(small * (clear + most - least), 0)
    light = known & (small < 1) & (reach < 0.2)
    steps = _steps(samples, 0)

    at = np.flatnonzero(light)
    full = np.where(whole & light, _micro(1.0, revenue), 0)
    whole_sums = np.zeros(len(totals), dtype=np.int64)
    np.add.at(whole_sums, codes[at], full[at])
    totals += whole_sums[:, None]
    bound = np.floor(np.exp(-reach[at]) * 2.0**32 - 2).astype(np.uint32)[:, None]
    boost = keys[at]
    boost[:, 0] += ((np.where(whole[at], _SLOTS, 0) + 3 * GAMMA_TRIES) * _WEYL % 2**32).astype(np.uint32)
    bits, spare = (np.empty((min(held, _LIGHT_LINES), samples), dtype=np.uint32) for _ in range(2))
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def put_off(of: np.ndarray, found: np.ndarray) -> None:
        lines, places = np.divmod(found, samples)
        pending.append((of[lines], places))
        if sum(len(i) for i, _ in pending) >= _PENDING:
            work_out()

    def work_out() -> None:
        lines, places = (np.concatenate(i) for i in zip(*pending, strict=True))
        pending.clear()
        own = _single(keys, steps, (lines, places))
        logs = (_log_gamma_draws(shape[lines], own, 1, first)[:, 0] for shape, first in ((a, 0), (b, _SLOTS)))
        np.add.at(totals, (codes[lines], places), _micro(_beta_of_logs(*logs), revenue[lines]) - full[lines])

    for start in range(0, len(at), len(bits)):
        part = slice(start, start + len(bits))
        x, y = (i[: len(boost[part])] for i in (bits, spare))
        _mix(boost[part], steps, x, y)
        put_off(at[part], np.flatnonzero(x >= bound[part]))

    of_one = (a >= 1) & (b >= 1)
    at, lines = np.flatnonzero(known & ~light & of_one), min(held, _LINES)
    gammas = _Gammas(2 * lines, samples)
    second = keys + np.array([_SLOTS * _WEYL % 2**32, 0], dtype=np.uint32)
    for start in range(0, len(at), lines):
        part = at[start : start + lines]
        drawn, failed = gammas(np.concatenate([a[part], b[part]]), np.concatenate([keys[part], second[part]]))
        x, y = np.split(drawn, 2)
        np.add(x, y, out=y)
        np.divide(x, y, out=x)
        failed = np.unique(failed % x.size)
        x.ravel()[failed] = 0
        put_off(part, failed)
        _sum_lines(totals, codes[part], _micro(x, revenue[part, None]))
    at = np.flatnonzero(known & ~light & ~of_one)
    for start in range(0, len(at), lines):
        part = at[start : start + lines]
        logs = (_log_gamma_draws(shape[part], keys[part], samples, first) for shape, first in ((a, 0), (b, _SLOTS)))
        _sum_lines(totals, codes[part], _micro(_beta_of_logs(*logs), revenue[part, None]))
    if pending:
        work_out()


def _pieces(batch: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """Rows in order, so many at most, cut where the sums of a piece could pass 64 bits."""
    for first in range(0, len(batch), most):
        rows = batch.iloc[first : first + most]
        filled = np.nan_to_num(np.cumsum(np.abs(rows["revenue"].to_numpy())) * _MICRO // (_MOST_MICRO / 2))
        ends = [0, *(np.flatnonzero(np.diff(filled)) + 1), len(rows)]
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            yield rows.iloc[start:end]


def task_sums(
    batches: Iterator[pd.DataFrame], samples: int, seed: int, draws: Callable[[pd.DataFrame, int, int], np.ndarray], drawn_at_once: int
) -> Iterator[pd.DataFrame]:
    """Revenue and draws weighted by it, summed per simulation and arm over all batches of a task.

    Sums are handed on before the end where there are many or they could pass 64 bits.
    """
    kept: dict[tuple, list] = {}
    weight = 0.0
    hashed = draws is hashed_draws

    def found() -> pd.DataFrame:
        return pd.DataFrame([(*key, *sums) for key, sums in kept.items()], columns=["sim_id", "arm", "revenue", "draws"])

    # hashed_sums cuts its rows itself.
    for rows in (piece for batch in batches for piece in _pieces(batch, max(len(batch), 1) if hashed else drawn_at_once)):
        codes = rows.groupby(["sim_id", "arm"], sort=False).ngroup().to_numpy()
        order = np.argsort(codes, kind="stable")
        rows, codes = rows.iloc[order], codes[order]
        revenue = rows["revenue"].to_numpy()
        more = float(np.abs(revenue).sum()) * _MICRO
        if not hashed and rows[["alpha_post", "beta_post"]].isna().any(axis=None):
            # A draw that is not known becomes the smallest integer, which Spark alone can add to another.
            more = math.inf
        if kept and (weight + more > _MOST_MICRO or len(kept) * samples > _MOST_SUMS):
            yield found()
            kept, weight = {}, 0.0
        weight += more
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        totals = np.zeros((len(starts), samples), dtype=np.int64)
        if hashed:
            hashed_sums(rows, codes, totals, seed, drawn_at_once)
        else:
            drawn_sums(rows, codes, totals, seed, drawn_at_once, draws)
        firsts = rows.iloc[starts]
        keys = zip(firsts["sim_id"], firsts["arm"], strict=True)
        for key, *sums in zip(keys, np.add.reduceat(revenue, starts), totals, strict=True):
            kept[key] = [x + y for x, y in zip(kept[key], sums, strict=True)] if key in kept else sums
    if kept:
        yield found()


def aa_beta(
    frame: DataFrame,
    prior: DataFrame | None,
    samples: int = 300,
    seed: int = 0,
    draws: Callable[[pd.DataFrame, int, int], np.ndarray] = stream_draws,
    drawn_at_once: int = _DRAWN_AT_ONCE,
) -> DataFrame:
    """Per simulation: share of Beta draws in which the second arm wins, and the decision.

    Every row draws from a stream of its own, keyed by seed, simulation, arm and item, so rows need not meet to be
    drawn. A task keeps the revenue and one array of revenue-weighted sums per simulation and arm, the array in millionths
    as integers, and Spark adds those: any cut of the rows into batches, tasks and retries gives the same. Rows that
    repeat simulation, arm and item share their draws. draws makes them: from numpy's streams, or with hashed_draws from
    hashes that SQL can repeat.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return task_sums(batches, samples, seed, draws, drawn_at_once)

    item = F.col(ITEM).cast("string")
    if draws is hashed_draws:
        # As in _hash_keys, which needs far more time.
        text = F.concat_ws("|", F.lit(str(seed)), F.col("sim_id").cast("string"), "arm", item)
        item = F.substring(F.unhex(F.md5(text.cast("binary"))), 1, 8).alias("key")
    else:
        item = item.alias("item")
    rows = _with_known_prior(frame, prior).select(
        "sim_id", "arm", item, "alpha_post", "beta_post", F.col("revenue").cast("double")
    )
    # Rows without revenue add nothing, those of no arm belong to neither.
    rows = rows.where((F.col("revenue") != 0) & F.col("arm").isNotNull())
    drawn = rows.mapInPandas(draw, "sim_id int, arm string, revenue double, draws array<long>")
    value = {"": F.col("value").cast("decimal(38,0)"), "_r_": F.col("revenue")}
    sums = (
        drawn.select("sim_id", "arm", "revenue", F.posexplode("draws").alias("draw", "value"))
        .groupBy("sim_id", "draw")
        .agg(*[F.sum(F.when(F.col("arm") == arm, v)).alias(f"{k}{arm}") for arm in ("a1", "a2") for k, v in value.items()])
    )
    share = {arm: F.try_divide(F.col(arm).cast("double"), F.col(f"_r_{arm}")) for arm in ("a1", "a2")}
    wins = sums.groupBy("sim_id").agg(F.avg((share["a2"] > share["a1"]).cast("int")).alias("a2_wins"))
    outside = (F.col("a2_wins") > 0.975) | (F.col("a2_wins") < 0.025)
    return wins.withColumn("false_positive", F.coalesce(outside, F.lit(False)).cast("int"))


def aa_agreement(drawn: DataFrame, normal_sims: DataFrame, near: float = 0.15, clear: float = 0.6) -> DataFrame:
    """Drawn check against the normal one, per simulation.

    near_normal: the drawn share lies within `near` of the normal probability (300
    draws have a standard error of 0.03 at most). false_positive: the drawn
    decision where the normal z is more than `clear` off the bound of 1.96, NULL
    where draws may fall on either side.
    """
    both = drawn.join(normal_sims.select("sim_id", "z"), "sim_id")
    expected = normal.cdf_column(F.col("z"))
    decided = F.abs(F.abs("z") - normal.two_sided_z(95)) > clear
    return both.select(
        "sim_id",
        (F.abs(F.col("a2_wins") - expected) <= near).cast("int").alias("near_normal"),
        F.when(decided, F.col("false_positive")).alias("false_positive"),
    )


def aa_bounds(drawn: DataFrame, normal_sims: DataFrame, bound: float = 0.05, clear: float = 0.6) -> DataFrame:
    """Over all simulations: the drawn false positives with their verdict, and the fewest and most that the normal check allows.

    A simulation whose normal z is within `clear` of the bound of 1.96 may be drawn to either side; the others are
    decided. drawn_within is 1 where the drawn count lies between the two and no decided simulation was drawn otherwise.
    """
    both = drawn.join(normal_sims.select("sim_id", "z"), "sim_id")
    off = F.abs("z") - normal.two_sided_z(95)
    # Without a z nothing is decided.
    least, most = F.coalesce(off > clear, F.lit(False)), F.coalesce(off >= -clear, F.lit(True))
    drawn_ones, rate = F.sum("false_positive").alias("false_positives"), F.avg("false_positive").alias("fp_rate")
    both = both.select("false_positive", least.cast("int").alias("_least"), most.cast("int").alias("_most"))
    sums = both.agg(
        F.count("*").alias("simulations"),
        F.sum("_least").alias("least_false_positives"),
        F.sum("_most").alias("most_false_positives"),
        F.min(F.col("false_positive").between(F.col("_least"), F.col("_most")).cast("int")).alias("drawn_within"),
        drawn_ones,
        rate,
    )

    def verdict(count: str) -> Column:
        return F.when(num.ratio(F.col(count), F.col("simulations")) <= bound, "SAFE").otherwise("NOISY")

    return sums.withColumns(
        {
            "verdict": verdict("false_positives"),
            "best_verdict": verdict("least_false_positives"),
            "worst_verdict": verdict("most_false_positives"),
        }
    )
