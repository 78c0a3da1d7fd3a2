"""Statistics against numpy on collected small data."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.functions.alpha import bonferroni_alpha, naive_alpha, obrien_fleming_alpha
from tidemark.operators import calibration, campaigns, ordering, sequential, shrinkage, trimming
from tidemark.plans import calibration_queries, shrinkage_queries
from tidemark.sources import roles


def delta_method(x, y):
    mx, my, n = x.mean(), y.mean(), len(x)
    return mx / my, (x.var() / my**2 + y.var() * mx**2 / my**4 - 2 * np.cov(x, y)[0, 1] * mx / my**3) / n


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(2)
    n = 240
    frame = pd.DataFrame(
        {
            "line_item_id": [f"li{i // 2}" for i in range(n)],
            "bid_strategy": ["A", "B"] * (n // 2),
            "optimization_goal": np.where(np.arange(n) % 3 == 0, "APP_INSTALLS", "SWIPES"),
        }
    )
    for arm in ("control", "treatment"):
        conv = rng.integers(0, 30, n).astype(float)
        frame[f"impressions_{arm}"] = rng.integers(1, 1000, n).astype(float)
        frame[f"conversions_{arm}"] = conv
        frame[f"predicted_conversions_{arm}"] = conv * rng.uniform(0.6, 1.4, n) + 0.5
        frame[f"revenue_{arm}"] = rng.uniform(1, 100, n)
    return frame, spark.createDataFrame(frame)


def readout(frame):
    items = frame.groupby("line_item_id")[list(calibration.PAIRED)].sum()
    out = {}
    for arm, a in (("control", "c"), ("treatment", "t")):
        pred, conv, rev = (items[f"{m}_{arm}"].to_numpy() for m in ("predicted_conversions", "conversions", "revenue"))
        out[f"cali_{a}"] = delta_method(pred, conv)
        ratio = np.divide(pred, conv, out=np.zeros_like(pred), where=conv != 0)
        out[f"perc_rev_sla_{a}"] = delta_method(rev * ((ratio >= 0.8) & (ratio <= 1.2)), rev)
    d = abs(out["cali_t"][0] - 1) - abs(out["cali_c"][0] - 1)
    width = 2 * normal.two_sided_z(95) * np.sqrt(out["cali_t"][1] + out["cali_c"][1])
    return out, d, width


def test_readout(wide):
    frame, df = wide
    rows = {r["optimization_goal"]: r for r in calibration.ab_readout(df).collect()}
    assert set(rows) == {"Overall", "APP_INSTALLS", "SWIPES"}
    for goal, part in (("Overall", frame), ("SWIPES", frame[frame.optimization_goal == "SWIPES"])):
        want, d, width = readout(part)
        for name, (value, _) in want.items():
            assert rows[goal][name] == pytest.approx(value)
        assert rows[goal]["cali_d"] == pytest.approx(d)
        assert rows[goal]["cali_d_ci_width"] == pytest.approx(width)
        assert rows[goal]["cali_d_ci_width_rel"] == pytest.approx(width / abs(d))
    assert calibration.ab_readout(df.drop("optimization_goal")).count() == 1
    text = calibration.readout_text(calibration.ab_readout(df)).first()
    assert text["cali_t_text"].count(",") == 1 and "%" in text["perc_rev_sla_c_text"]


def test_guards(spark):
    one = spark.createDataFrame([("a", 3, 2.0, 3.0, 5.0)], "line_item_id string, impressions int, conversions double, conversions_pred double, revenue double")
    row = calibration.calibration_readout(calibration.with_sla(one)).first()
    assert (row["calibration"], row["calibration_var"]) == (1.5, 0.0)
    none = calibration.with_sla(one.withColumn("conversions", F.lit(0.0)))
    row = calibration.calibration_readout(none).first()
    assert (row["calibration"], row["calibration_var"], row["pct_rev_sla"]) == (0.0, 0.0, 0.0)
    measures = calibration.weighted_calibration(none).first()
    assert measures["weighted_calibration_smoothed"] == 4.0 and measures["rows_without_conversions"] == 1


def test_band_edges(spark):
    rows = [("a", 1, 10.0, 8.0, 1.0), ("b", 1, 10.0, 12.0, 1.0), ("c", 1, 10.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "line_item_id string, impressions int, conversions double, conversions_pred double, revenue double")
    row = calibration.calibration_readout(calibration.with_sla(df)).first()
    assert row["pct_rev_sla"] == 1.0 and row["pct_rev_sla_open"] == pytest.approx(1 / 3)


def test_weighted_measures(spark):
    rng = np.random.default_rng(1)
    w, p, c = rng.uniform(1, 9, 50), rng.uniform(1, 9, 50), rng.integers(1, 9, 50).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"revenue": w, "conversions_pred": p, "conversions": c}))
    row = calibration.weighted_calibration(df).first()
    r = p / c
    for name, x in (
        ("weighted_calibration", w * r), ("weighted_abs_error", w * abs(r - 1)),
        ("weighted_abs_error_symmetric", w * np.where(r > 1, 1 - 1 / r, 1 - r)),
    ):
        value, var = delta_method(x, w)
        assert row[name] == pytest.approx(value) and row[f"{name}_var"] == pytest.approx(var)


@pytest.mark.parametrize("direction", ["left", "right", "both"])
def test_trim(wide, direction):
    frame, df = wide
    v = frame["revenue_control"]
    low, high = np.percentile(v, 10), np.percentile(v, 90)
    keep = {"left": v >= low, "right": v <= high, "both": (v >= low) & (v <= high)}[direction]
    assert trimming.trim(df, "revenue_control", 10, direction).count() == keep.sum()
    assert trimming.trim(df, "revenue_control", 0, direction).count() == len(frame)


def test_trim_grid_equals_trimming_then_reading(wide):
    frame, df = wide
    cells = trimming.readouts(df, ["impressions_control"], ["left", "both"], [0, 5, 20], ["APP_INSTALLS"])
    got = {(r["direction"], r["pct_cut"], r["optimization_goal"]): r for r in cells.collect()}
    assert len(got) == (2 * 3 + 1) * 2
    v = frame["impressions_control"]
    for direction, pct in (("left", 5.0), ("both", 20.0), ("left", 0.0)):
        low, high = np.percentile(v, pct), np.percentile(v, 100 - pct)
        kept = frame[(v >= low) & ((v <= high) if direction == "both" else True)]
        _, d, width = readout(kept)
        row = got[direction, pct, "Overall"]
        assert row["rows_kept"] == len(kept)
        assert row["cali_d"] == pytest.approx(d) and row["cali_d_ci_width"] == pytest.approx(width)
        assert row["revenue_kept"] == pytest.approx((kept.revenue_control + kept.revenue_treatment).sum())
    summary = trimming.revenue_summary(cells).where("direction = 'left' AND pct_cut = 0").first()
    assert summary["revenue_cut_out"] == 0 and summary["cali_d_ci_reduction"] == 0
    assert trimming.estimates(cells).count() == 6


def test_trim_grid_deals_more_tasks_to_more_rows(wide, monkeypatch):
    frame, df = wide
    monkeypatch.setattr(trimming, "SUMS_PER_TASK", 10)
    cells = trimming.readouts(df, ["impressions_control"], ["left", "both"], [0, 5, 20])
    dealt = re.findall(r"hashpartitioning\(line_item_id#\d+, (\d+)\), REPARTITION_BY_NUM", cells._jdf.queryExecution().toString())
    assert dealt and int(dealt[0]) == len(frame) * 3 * 2 // 10
    row = cells.where("direction = 'both' AND pct_cut = 20 AND optimization_goal = 'Overall'").first()
    v = frame["impressions_control"]
    assert row["rows_kept"] == ((v >= np.percentile(v, 20)) & (v <= np.percentile(v, 80))).sum()


def test_trim_estimates_hold_no_sums_per_item_and_cut(wide):
    frame, df = wide
    frame = pd.concat([frame, frame.assign(bid_strategy="C", impressions_control=frame["impressions_control"] * 3)])
    cells = trimming.readouts(
        df.unionByName(df.withColumns({"bid_strategy": F.lit("C"), "impressions_control": F.col("impressions_control") * 3})),
        ["impressions_control"], ["right"], [0, 10, 30, 60],
    )
    found = trimming.estimates(cells)
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert any("line_item_id" in k for k in keys)
    assert not [k for k in keys if "line_item_id" in k and "_cut#" in k]
    v = frame["impressions_control"]
    for row in found.collect():
        _, d, width = readout(frame[v <= np.percentile(v, 100 - row["pct_cut"])])
        assert row["cali_d"] == pytest.approx(d) and row["cali_d_hi"] - row["cali_d_lo"] == pytest.approx(width)


def _fact_tables(spark, folder):
    """200 orders of 3 lines, over 20 items and 40 accounts, all of them shipped while the experiment ran."""
    spark.range(40).selectExpr("id AS c_custkey", "'MACHINERY' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.range(200).selectExpr(
        "id AS o_orderkey", "id % 40 AS o_custkey", "timestamp'1995-12-28' AS o_orderdate",
        "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM'), cast(1 + id % 3 as int)) AS o_orderpriority",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(600).selectExpr(
        "cast(floor(id / 3) as bigint) AS l_orderkey", "1 + id % 20 AS l_partkey", "1 + id % 6 AS l_suppkey",
        "cast(2 + id % 3 as int) AS l_linenumber", "cast(1 + id % 11 as double) AS l_quantity",
        "cast(100 + id as double) AS l_extendedprice", "0D AS l_discount", "timestamp'1997-03-01' AS l_shipdate",
    ).write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("query", ["trim_estimates", "trim_rows"])
def test_trim_queries_roll_up_in_more_partitions_for_more_rows(spark, tmp_path, monkeypatch, query):
    folder, kept, settle = str(tmp_path), [], ordering.settle
    _fact_tables(spark, folder)

    def noted(*args):
        kept.append(settle(*args))
        return kept[-1]

    monkeypatch.setattr(ordering, "settle", noted)
    run = calibration_queries.QUERIES[query]
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n) for n in names]
    few = sorted(map(str, run(spark, folder).collect()))
    monkeypatch.setattr(ordering, "ROWS_PER_PARTITION", 60)
    many = sorted(map(str, run(spark, folder).collect()))
    assert [df.rdd.getNumPartitions() for df in kept] == [4, 600 // 60]
    assert few and few == many
    assert [spark.conf.get(n) for n in names] == before


def test_settling_puts_the_settings_back_after_a_failure(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_PARTITION", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    failing = spark.range(9).groupBy((F.col("id") % 3).alias("k")).agg(F.raise_error(F.first(F.lit("no"))).alias("x"))
    with pytest.raises(Exception, match="no"):
        ordering.settle(failing, 9)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_trim_checks(wide):
    _, df = wide
    with pytest.raises(ValueError):
        trimming.trim(df, "nothing", 5)
    with pytest.raises(ValueError):
        trimming.trim(df, "revenue_control", 5, "up")


# --- sequential ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def observed(spark):
    rng = np.random.default_rng(8)
    rows = []
    for name, shift, nc, nt in (("up", 2.0, 230, 260), ("flat", 0.0, 200, 200), ("one", 0.0, 1, 1), ("large", 0.5, 150, 120)):
        base = 1e7 if name == "large" else 0.0
        rows += [(name, "control", i + 1, base + x) for i, x in enumerate(rng.normal(0, 1, nc))]
        rows += [(name, "treatment", i + 1, base + x) for i, x in enumerate(rng.normal(shift, 1, nt))]
    frame = pd.DataFrame(rows, columns=["experiment_id", "arm", "step", "x"])
    return frame, spark.createDataFrame(frame)


def arms(frame, name):
    part = frame[frame.experiment_id == name]
    c, t = (part[part.arm == a].sort_values("step")["x"].to_numpy() for a in ("control", "treatment"))
    n = min(len(c), len(t))
    return c[:n], t[:n], len(c), len(t)


@pytest.mark.parametrize("block_steps", [7, 10_000])
def test_expanding_moments(observed, block_steps):
    frame, df = observed
    moments = sequential.with_own_mean_spread(sequential.expanding_moments(df, block_steps)).toPandas()
    for name in ("up", "flat", "one", "large"):
        c, t, nc, nt = arms(frame, name)
        got = moments[moments.experiment_id == name].sort_values("step")
        steps = np.arange(1, len(c) + 1)
        for x, a in ((c, "c"), (t, "t")):
            mean = np.cumsum(x) / steps
            assert np.allclose(got[f"mean_{a}"], mean)
            assert np.allclose(got[f"stdev_{a}"], np.sqrt(np.cumsum((x - mean) ** 2) / steps), atol=1e-6)
            want = [np.var(x[:i], ddof=1) for i in range(2, len(x) + 1)]
            assert np.allclose(got[f"var_{a}"].to_numpy()[1:], want, rtol=1e-6)
        assert set(got["full_c"]) == {nc} and set(got["full_t"]) == {nt}


def test_peeks(observed):
    frame, df = observed
    got = sequential.peek_intervals(df, 50, bonferroni_alpha, mu=0.0, block_steps=40).toPandas()
    c, t, *_ = arms(frame, "up")
    peeks = list(range(50, len(c) + 1, 50))
    z = -normal.quantile(0.05 / len(peeks) / 2)
    rows = got[got.experiment_id == "up"].sort_values("peek")
    assert rows["peek"].tolist() == peeks

    def own(x, i):
        m = np.cumsum(x) / np.arange(1, len(x) + 1)
        return np.sum((x[:i] - m[:i]) ** 2) / i

    for i, row in zip(peeks, rows.itertuples()):
        d = t[:i].mean() - c[:i].mean()
        width = z * np.sqrt(own(c, i) + own(t, i)) / np.sqrt(i)
        assert row.mean_diff == pytest.approx(d) and row.width == pytest.approx(width)
    assert set(rows["length"]) == {50} and set(rows["power"]) == {1}
    assert "one" not in set(got.experiment_id)


def test_width_falls_with_more_data(observed):
    _, df = observed
    rows = sequential.peek_intervals(df, 50, naive_alpha).where("experiment_id = 'flat'").orderBy("peek").collect()
    widths = [r["width"] for r in rows]
    assert widths == sorted(widths, reverse=True)


def test_msprt(observed):
    frame, df = observed
    steps = sequential.msprt_steps(df, block_steps=33).toPandas()
    c, t, nc, nt = arms(frame, "up")
    z2 = normal.two_sided_z(95) ** 2
    first = None
    rows = steps[steps.experiment_id == "up"].set_index("step")
    for i in range(2, len(c) + 1):
        vc, vt = np.var(c[:i], ddof=1), np.var(t[:i], ddof=1)
        tau, v = z2 * (vc / nc + vt / nt), vc / i + vt / i
        ci = np.sqrt(v * (v + tau) / tau) * np.sqrt(-2 * np.log(0.05) - np.log(v / (v + tau)))
        delta = t[:i].mean() - c[:i].mean()
        assert rows.loc[i, "ci"] == pytest.approx(ci) and rows.loc[i, "delta"] == pytest.approx(delta)
        if first is None and abs(delta) > ci:
            first = i
    readout = {r["experiment_id"]: r for r in sequential.msprt_readout(sequential.msprt_steps(df)).collect()}
    assert readout["up"]["length"] == first and readout["up"]["rejected"] == 1
    assert "one" not in readout


def test_constant_values_have_no_decision(spark):
    rows = [("k", arm, i, 1.0) for arm in ("control", "treatment") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "experiment_id string, arm string, step int, x double")
    got = sequential.msprt_steps(df).collect()
    assert {r["decision"] for r in got} == {None} and {r["length"] for r in got} == {5}


# --- shrinkage ---------------------------------------------------------------------------


def test_posteriors(spark):
    schema = "line_item_id string, conversions double, conversions_pred double, revenue double, sla_flag int, rev_sla double"
    items = spark.createDataFrame([("a", 16.0, 16.0, 10.0, 1, 10.0), ("b", 4.0, 9.0, 5.0, 0, 0.0), ("c", 0.0, 1.0, 1.0, 0, 0.0)], schema)
    prior = shrinkage.priors(items.where("line_item_id <> 'b'"))
    got = {r["line_item_id"]: r for r in shrinkage.posteriors(items, prior).collect()}
    alpha = (1 - 1e-6) * 4
    assert got["a"]["post_sla_li"] == pytest.approx((alpha + 4) / 8)
    assert got["b"]["post_sla_li"] is None
    assert shrinkage.id_overlap(items, prior).first()["overlap_ratio"] == pytest.approx(2 / 3)


def test_prior_strength_and_dispersion(spark):
    rng = np.random.default_rng(3)
    flag, conv = rng.integers(0, 2, 80), rng.integers(0, 200, 80).astype(float)
    frame = pd.DataFrame({"line_item_id": range(80), "sla_flag": flag, "conversions": conv, "conversions_pred": conv * 1.1 + 1})
    df = spark.createDataFrame(frame)
    row = shrinkage.prior_strength(df).first()
    w = np.sqrt(conv + 1e-6)
    p = np.average(flag, weights=w)
    v = np.average((flag - p) ** 2, weights=w)
    assert row["p_bar"] == pytest.approx(p) and row["v_bar"] == pytest.approx(v)
    assert row["nu_est"] == pytest.approx(p * (1 - p) / v - 1, abs=1e-9)
    over = shrinkage.overdispersion(df).first()
    assert over["count_dispersion"] == pytest.approx(conv.var() / conv.mean())
    assert over["binary_dispersion"] == pytest.approx(flag.var(ddof=1) / (flag.mean() * (1 - flag.mean())))
    labels = {r[0] for r in df.select(shrinkage.conversion_bucket(F.lit(0.0))).collect()}
    assert labels == {None}


def test_beta_draws_are_repeatable_and_close_to_the_normal(spark):
    rng = np.random.default_rng(4)
    n = 60
    wide = pd.DataFrame({"iteration_id": np.arange(n) % 2, "line_item_id": [f"li{i}" for i in range(n)]})
    for a in ("a1", "a2"):
        wide[f"conv_{a}"] = rng.integers(1, 80, n).astype(float)
        wide[f"pred_conv_{a}"] = wide[f"conv_{a}"] * rng.uniform(0.5, 1.5, n)
        wide[f"rev_{a}"] = rng.uniform(1, 50, n)
    df = spark.createDataFrame(wide).withColumn("iteration_id", F.col("iteration_id").cast("int"))
    frame = shrinkage.aa_frame(df)
    prior = shrinkage.priors(frame.where("arm = 'a1'"))
    once = {r["sim_id"]: r["a2_wins"] for r in shrinkage.aa_beta(frame, prior, 400, 7).collect()}
    again = {r["sim_id"]: r["a2_wins"] for r in shrinkage.aa_beta(frame.repartition(5), prior, 400, 7).collect()}
    assert once == again
    for r in shrinkage.aa_normal(frame, prior).collect():
        assert once[r["sim_id"]] == pytest.approx(normal.cdf(r["z"]), abs=0.12)
    assert shrinkage.aa_verdict(shrinkage.aa_normal(frame, prior)).first()["verdict"] in ("SAFE", "NOISY")


def test_null_keys_are_no_groups(spark):
    facts = spark.createDataFrame(
        [(1, "a", 2.0, 2.0, 5.0), (None, "a", 1.0, 1.0, 5.0), (None, "b", 1.0, 2.0, 7.0)],
        "sim_id int, line_item_id string, conversions double, predicted_conversions double, revenue double",
    ).withColumns({"serve_item_id": F.lit("s"), "optimization_goal": F.lit("g")})
    items = calibration.line_items(facts, by_sim=True)
    assert [r["sim_id"] for r in calibration.totals(items).collect()] == [1]
    assert [r["revenue"] for r in calibration.totals(items, by=()).collect()] == [17.0]
    posterior = shrinkage.posteriors(items, shrinkage.priors(calibration.line_items(facts)))
    assert [r["sim_id"] for r in shrinkage.posterior_totals(posterior).collect()] == [1]


def test_campaign_pivots_drop_null_keys(spark):
    rows = spark.createDataFrame(
        [("S", "CLICK", "2000Q1", "c", 3), (None, "CLICK", "2000Q1", "c", 9), ("S", None, "2000Q1", "c", 9)],
        "surface string, action string, quarter string, campaign_id string, action_cnt long",
    )
    assert [tuple(r) for r in campaigns.action_change(rows, ["2000Q1"]).collect()] == [("S", "CLICK", 3)]
    assert [r["surface"] for r in campaigns.overall_rates(rows).collect()] == ["S"]


def test_drawn_check_does_not_depend_on_partitions_or_batches(spark):
    frame = spark.createDataFrame(
        [(s, f"i{i}", arm, 10.0 + i, 5.0 * i, i % 2) for s in (1, 2) for i in range(60) for arm in ("a1", "a2")],
        "sim_id int, line_item_id string, arm string, conversions double, revenue double, sla_flag int",
    )
    prior = frame.where("sim_id = 1 AND arm = 'a1'").select("line_item_id", F.lit(2.0).alias("alpha"), F.lit(3.0).alias("beta"))
    first = sorted(shrinkage.aa_beta(frame.repartition(1), prior).collect())
    assert first == sorted(shrinkage.aa_beta(frame.repartition(8), prior).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert first == sorted(shrinkage.aa_beta(frame.orderBy(F.desc("revenue")), prior).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(0.35 < r["a2_wins"] < 0.65 and r["false_positive"] == 0 for r in first)


def test_drawn_rows_are_shuffled_as_sums_alone(spark):
    frame = spark.createDataFrame([(1, "i", "a1", 1.0, 5.0, 1)], "sim_id int, line_item_id string, arm string, conversions double, revenue double, sla_flag int")
    prior = frame.select("line_item_id", F.lit(2.0).alias("alpha"), F.lit(3.0).alias("beta"))
    plan = shrinkage.aa_beta(frame, prior)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_drawn_verdict_counts_every_simulation(spark):
    sf_dir = "/root/testdata/sf0.001"
    frame = shrinkage.aa_frame(roles.aa_wide(spark, sf_dir))
    prior = shrinkage.priors(calibration.line_items(roles.served_items(spark, sf_dir)))
    rows = frame.where("sim_id IS NOT NULL AND revenue <> 0").join(prior, "line_item_id")
    rows = rows.withColumn("revenue", F.col("revenue").cast("double")).toPandas()
    root = np.sqrt(rows["conversions"].astype(float))
    rows["a"] = rows["alpha"] + rows["sla_flag"] * root
    rows["b"] = rows["beta"] + root - rows["sla_flag"] * root
    decided = {}
    for sim in sorted(rows["sim_id"].unique()):
        arms = []
        for arm in ("a1", "a2"):
            own, sums = rows[(rows["sim_id"] == sim) & (rows["arm"] == arm)], 0
            for r in own.itertuples():
                key = hashlib.blake2b(f"0|{sim}|{arm}|{r.line_item_id}".encode(), digest_size=16).digest()
                draws = np.random.Generator(np.random.Philox(key=np.frombuffer(key, dtype=np.uint64))).beta(r.a, r.b, 300)
                sums = sums + np.rint(r.revenue * draws * 1e6)
            arms.append(sums / own["revenue"].sum())
        wins = (arms[1] > arms[0]).mean()
        decided[sim] = int(wins > 0.975 or wins < 0.025)
    drawn = shrinkage.aa_beta(frame, prior)
    assert {r["sim_id"]: r["false_positive"] for r in drawn.collect()} == decided
    got = shrinkage.aa_verdict(drawn).first()
    assert (got["simulations"], got["false_positives"]) == (len(decided), sum(decided.values()))
    bounds = shrinkage_queries.aa_beta_verdict(spark, sf_dir).first()
    assert bounds["simulations"] == len(decided) and bounds["drawn_within"] == 1
    assert bounds["least_false_positives"] < bounds["most_false_positives"]
    assert bounds["least_false_positives"] <= got["false_positives"] <= bounds["most_false_positives"]


def test_hashed_draws_follow_the_beta():
    for a, b in ((0.3, 0.4), (1.0, 1.0), (2.5, 0.2), (5.0, 9.0), (40.0, 33.0)):
        rows = pd.DataFrame({"sim_id": 3, "arm": "a1", "item": [f"i{i}" for i in range(500)], "alpha_post": a, "beta_post": b})
        drawn = shrinkage.hashed_draws(rows, 0, 300)
        mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
        assert abs(drawn.mean() - mean) < 5 * np.sqrt(var / drawn.size)
        assert drawn.var() == pytest.approx(var, rel=0.03)
        want = np.quantile(np.random.default_rng(1).beta(a, b, drawn.size), [0.05, 0.25, 0.5, 0.75, 0.95])
        assert np.quantile(drawn, [0.05, 0.25, 0.5, 0.75, 0.95]) == pytest.approx(want, abs=0.01)
        assert (shrinkage.hashed_draws(rows.iloc[200:300], 0, 300) == drawn[200:300]).all()
    assert (shrinkage.hashed_draws(rows.assign(beta_post=np.nan), 0, 10) == 0).all()
    with pytest.raises(ValueError):
        shrinkage.hashed_draws(rows.assign(beta_post=0.0), 0, 10)


def test_drawn_verdict_returns_the_drawn_false_positives(spark):
    """Simulation 1 differs clearly, 2 does not, 3 has a z near the bound; all are counted by their own draws."""
    made = [
        (sim, f"i{i}", arm, 30.0, 5.0 + i, int(arm == "a2" and i < high))
        for sim, high in ((1, 40), (2, 0), (3, 5)) for i in range(40) for arm in ("a1", "a2")
    ]
    frame = spark.createDataFrame(made, "sim_id int, line_item_id string, arm string, conversions double, revenue double, sla_flag int")
    prior = frame.where("sim_id = 1 AND arm = 'a1'").select("line_item_id", F.lit(2.0).alias("alpha"), F.lit(3.0).alias("beta"))
    decided = {}
    for sim in (1, 2, 3):
        arms = {}
        for arm in ("a1", "a2"):
            own = pd.DataFrame([r for r in made if r[0] == sim and r[2] == arm], columns=["sim_id", "item", "arm", "conv", "rev", "flag"])
            root = np.sqrt(own["conv"])
            own["alpha_post"], own["beta_post"] = 2 + own["flag"] * root, 3 + root - own["flag"] * root
            drawn = shrinkage.hashed_draws(own, 0, 300)
            arms[arm] = (drawn * own["rev"].to_numpy()[:, None]).sum(axis=0) / own["rev"].sum()
        wins = (arms["a2"] > arms["a1"]).mean()
        decided[sim] = int(wins > 0.975 or wins < 0.025)
    assert (decided[1], decided[2]) == (1, 0)
    drawn = shrinkage.aa_beta(frame, prior, draws=shrinkage.hashed_draws, drawn_at_once=7)
    assert {r["sim_id"]: r["false_positive"] for r in drawn.collect()} == decided
    row = shrinkage.aa_bounds(drawn, shrinkage.aa_normal(frame, prior)).first()
    assert (row["simulations"], row["false_positives"], row["verdict"]) == (3, sum(decided.values()), "NOISY")
    assert row["fp_rate"] == pytest.approx(sum(decided.values()) / 3)


def _odd_rows(n):
    """Shapes from tiny to huge on either side, unknown ones, and amounts of either sign from far below a millionth up."""
    rng = np.random.default_rng(8)

    def shapes():
        kinds = [
            rng.uniform(5e-6, 4e-5, n), rng.uniform(1, 40, n), rng.uniform(0.01, 1, n), 10 ** rng.uniform(-9, 0, n),
            10 ** rng.uniform(0, 6, n), np.ones(n), 10 ** rng.uniform(-3, -1.5, n),
        ]
        return np.choose(rng.integers(0, len(kinds), n), kinds)

    rows = pd.DataFrame({"sim_id": 1, "arm": "a1", "item": [f"i{i}" for i in range(n)], "alpha_post": shapes(), "beta_post": shapes()})
    rows["revenue"] = np.where(rng.random(n) < 0.2, -1, 1) * 10 ** rng.uniform(-8, 7, n)
    rows.loc[rng.random(n) < 0.05, "alpha_post"] = np.nan
    return rows


def test_sums_of_hashed_draws_are_those_of_each_draw():
    rows = _odd_rows(1_500)
    want = np.rint(shrinkage.hashed_draws(rows, 0, 300) * rows["revenue"].to_numpy()[:, None] * 1e6).astype(np.int64)
    lines, got = np.arange(len(rows)), np.zeros_like(want)
    shrinkage.hashed_sums(rows, lines, got, 0, 256)
    # Where neither shape is below 1 the last bit of a draw may differ, and with it a millionth.
    assert np.abs(got - want).max() <= 1 and (got != want).mean() < 1e-4
    assert (got == want)[rows[["alpha_post", "beta_post"]].min(axis=1) < 1].all()
    backwards = np.zeros_like(want)
    shrinkage.hashed_sums(rows.iloc[::-1], lines, backwards, 0, 7)
    assert (backwards[::-1] == got).all()
    codes, totals = lines // 100, np.zeros((15, 300), dtype=np.int64)
    shrinkage.hashed_sums(rows, codes, totals, 0, 256)
    assert (totals == got.reshape(15, 100, 300).sum(axis=1)).all()


def test_few_hashed_draws_of_flag_priors_need_logarithms(monkeypatch):
    """A prior from a flag has a tiny shape, so that nearly all draws are 0 or 1 to the last millionth."""
    n, worked_out = 400, []
    rows = pd.DataFrame({"sim_id": 1, "arm": "a1", "item": [f"i{i}" for i in range(n)], "conversions": 30.0, "revenue": 900.0})
    flag = np.arange(n) % 2
    rows["alpha_post"], rows["beta_post"] = np.where(flag, 11.0, 2e-5), np.where(flag, 2e-5, 11.0)
    logs = shrinkage._log_gamma_draws

    def counted(shape, keys, samples, first):
        worked_out.append(len(shape) * samples)
        return logs(shape, keys, samples, first)

    monkeypatch.setattr(shrinkage, "_log_gamma_draws", counted)
    (found,) = shrinkage.task_sums(iter([rows]), 300, 0, shrinkage.hashed_draws, 256)
    assert 0 < sum(worked_out) < 0.01 * 2 * 300 * n
    want = np.rint(shrinkage.hashed_draws(rows, 0, 300) * 900 * 1e6).astype(np.int64).sum(axis=0)
    assert (found["draws"][0] == want).all() and found["revenue"][0] == 900 * n


@pytest.mark.parametrize("draws", [shrinkage.hashed_draws, shrinkage.stream_draws])
def test_a_task_hands_on_one_sum_per_simulation_and_arm(draws):
    rows = _odd_rows(600).dropna()
    rows["sim_id"], rows["arm"] = np.arange(len(rows)) % 2, np.where(np.arange(len(rows)) % 3, "a1", "a2")
    batches = [rows.iloc[i : i + 20] for i in range(0, len(rows), 20)] + [rows.iloc[:0]]
    (found,) = shrinkage.task_sums(iter(batches), 30, 0, draws, 7)
    assert len(found) == 4
    for r in found.itertuples():
        own = rows[(rows["sim_id"] == r.sim_id) & (rows["arm"] == r.arm)]
        want = np.rint(draws(own, 0, 30) * own["revenue"].to_numpy()[:, None] * 1e6).astype(np.int64).sum(axis=0)
        assert np.abs(r.draws - want).max() <= 3 and r.revenue == pytest.approx(own["revenue"].sum())


def test_sums_are_handed_on_before_they_pass_64_bits():
    n = 60
    rows = pd.DataFrame({"sim_id": 1, "arm": "a1", "item": [f"i{i}" for i in range(n)], "alpha_post": 9.0, "beta_post": 1e-9, "revenue": 1e12})
    found = pd.concat(shrinkage.task_sums(iter([rows]), 5, 0, shrinkage.hashed_draws, 256))
    assert len(found) > 1
    assert sum(int(draws[0]) for draws in found["draws"]) == n * 10**18 and found["revenue"].sum() == n * 1e12


def test_prior_joined_side_by_side_is_the_prior_of_both_arms(spark):
    n = 60
    rng = np.random.default_rng(5)
    wide = pd.DataFrame({"iteration_id": np.arange(n) % 2, "line_item_id": [f"li{i % 30}" for i in range(n)]})
    for a in ("a1", "a2"):
        wide[f"conv_{a}"] = rng.integers(0, 80, n).astype(float)
        wide[f"pred_conv_{a}"] = wide[f"conv_{a}"] * rng.uniform(0.5, 1.5, n)
        wide[f"rev_{a}"] = np.where(rng.random(n) < 0.2, 0, rng.uniform(1, 50, n))
    df = spark.createDataFrame(wide).withColumn("iteration_id", F.expr("CASE WHEN line_item_id <> 'li7' THEN cast(iteration_id as int) END"))
    frame = shrinkage.aa_frame(df)
    known = shrinkage.priors(frame.where("arm = 'a1' AND sim_id = 0 AND line_item_id <> 'li4'"))
    # A prior that comes twice counts twice, either way.
    prior = known.unionAll(known.where("line_item_id = 'li8'"))
    both = shrinkage.known_aa_frame(df, prior)
    draw = {"samples": 50, "draws": shrinkage.hashed_draws}
    assert sorted(shrinkage.aa_beta(both, None, **draw).collect()) == sorted(shrinkage.aa_beta(frame, prior, **draw).collect())
    got, want = (x.orderBy("sim_id").collect() for x in (shrinkage.aa_normal(both, None), shrinkage.aa_normal(frame, prior)))
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert list(g) == pytest.approx(list(w))


def test_alpha_policies_as_columns_equal_their_functions(spark):
    sizes = spark.createDataFrame([("a", 700), ("b", 100), ("c", 99), ("d", 20_000)], "experiment_id string, n long")
    for policy in (naive_alpha, bonferroni_alpha, obrien_fleming_alpha):
        found = sequential.alpha_schedule(sizes, 100, policy)
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        own = sequential.alpha_schedule(sizes, 100, lambda peek, n, peeks, policy=policy: policy(peek, n, peeks))
        assert "Python" in own._jdf.queryExecution().executedPlan().toString()
        pick = ["experiment_id", "peek", "peek_window", "last_peek", "alpha", "z"]
        for got, want in zip(found.select(pick).orderBy(pick[:2]).collect(), own.select(pick).orderBy(pick[:2]).collect(), strict=True):
            assert got[:4] == want[:4]
            assert got["alpha"] == pytest.approx(want["alpha"], rel=1e-11, abs=1e-300)
            assert got["z"] == pytest.approx(want["z"], rel=1e-11)


def test_normal_columns_to_full_digits(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.025, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.975, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(normal.quantile_column(F.col("p"))).collect()
    assert [r[0] for r in got] == [pytest.approx(normal.quantile(p), rel=1e-13, abs=1e-15) for p in ps]
    xs = [-37.0, -20.0, -8.0, -7.1, -7.0, -3.0, -1.96, -0.1, 0.0, 0.1, 1.96, 3.0, 7.0, 8.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(normal.cdf_column(F.col("x"))).collect()
    assert [r[0] for r in got] == [pytest.approx(normal.cdf(x), rel=1e-6 if x < -7.07 else 1e-12) for x in xs]
    odd = spark.createDataFrame([(0.0,), (1.0,), (-0.1,), (None,)], "p double").select(normal.quantile_column(F.col("p")))
    assert [r[0] for r in odd.collect()] == [float("-inf"), float("inf"), None, None]
