"""Block-wise ordering against brute force, with one group holding a third of the rows and more."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    frame = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 20, n).astype(str)),
            "v": np.where(rng.random(n) < 0.35, 7.0, rng.integers(0, 60, n).astype(float)),
            "id": np.arange(n),
            "x": rng.normal(size=n),
        }
    )
    return frame, spark.createDataFrame(frame).repartition(7)


def test_row_numbers_and_running_sums(skewed):
    frame, df = skewed
    blocked, cut = ordering.with_blocks(df, ["g"], ["v", "id"], rows_per_block=250)
    sizes = {r["_block"]: r["count"] for r in blocked.where("g = 'hot'").groupBy(ordering.BLOCK).count().collect()}
    assert cut and len(sizes) >= 5 and max(sizes.values()) < 750
    assert blocked.where("g <> 'hot'").select(ordering.BLOCK).distinct().count() == 1
    got = ordering.running(blocked, ["g"], ["v", "id"], {"rn": F.lit(1), "s": F.col("x")}).toPandas()
    want = frame.sort_values(["g", "v", "id"])
    want["rn"] = want.groupby("g").cumcount() + 1
    want["s"] = want.groupby("g")["x"].cumsum()
    both = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(both) == len(frame)
    assert (both["rn"] == both["rn_w"]).all()
    assert np.allclose(both["s"], both["s_w"])


@pytest.mark.parametrize("rows_per_block", [None, 200])
def test_percent_ranks(skewed, rows_per_block):
    frame, df = skewed
    some_null = df.withColumn("v", F.when(F.col("id") % 11 != 0, F.col("v")))
    got = ordering.percent_ranks(some_null, "g", "v", "r", ["id"], rows_per_block).toPandas()
    want = frame.assign(v=frame["v"].where(frame["id"] % 11 != 0, -1.0))
    rank = want.groupby("g")["v"].rank(method="min", ascending=False) - 1
    size = want.groupby("g")["v"].transform("size")
    want["r"] = np.where(size == 1, 0.0, rank / np.maximum(size - 1, 1))
    both = got.merge(want[["id", "r"]], on="id", suffixes=("", "_w"))
    assert len(both) == len(frame) and np.allclose(both["r"], both["r_w"])


def test_exact_percentiles(skewed, spark):
    frame, df = skewed
    shares = [0.0, 0.05, 0.25, 0.5, 0.975, 1.0]
    got = ordering.exact_percentiles(df, {"v": shares, "x": shares})
    for column in ("v", "x"):
        row = spark.range(1).select(got[column]).first()[0]
        assert np.allclose(row, np.percentile(frame[column], [s * 100 for s in shares]))
    empty = spark.createDataFrame([], "v double")
    assert tuple(spark.range(1).select(ordering.exact_percentiles(empty, {"v": [0.5]})["v"][0]).first()) == (None,)


def test_row_numbers_without_a_group_and_whole_sizes(skewed):
    frame, df = skewed
    for rows_per_block in (None, 100):
        got = ordering.row_numbers(df, [], ["v", "id"], "rn", "size", rows_per_block).toPandas().sort_values("rn")
        assert got["id"].tolist() == frame.sort_values(["v", "id"])["id"].tolist()
        assert got["rn"].tolist() == list(range(1, 3001)) and set(got["size"]) == {3000}


def test_ordered_work_checkpoints_no_rows(spark):
    df = spark.range(3000).selectExpr("id % 2 AS g", "id % 97 AS v", "id")

    def plan(found):
        return found._jdf.queryExecution().optimizedPlan().toString()

    assert "LogicalRDD" not in plan(ordering.row_numbers(df, ["g"], ["v", "id"], "rn"))
    assert "LogicalRDD" not in plan(ordering.percent_ranks(df, "g", "v", "r", ["id"]))
    # What is kept where groups are cut are their bounds.
    kept = [x for x in plan(ordering.row_numbers(df, ["g"], ["v", "id"], "rn", rows_per_block=100)).split("\n") if "LogicalRDD" in x]
    assert kept and all("_bounds" in x for x in kept)


def test_percentiles_over_wide_ranges_few_bins_and_copies(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.lognormal(0, 6, 4000), -rng.lognormal(0, 6, 2000), np.full(3000, 7.25), [0.0, 1e300, -1e300, 1e-300]])
    df = spark.createDataFrame(pd.DataFrame({"v": values, "w": -values})).repartition(5)
    shares = [0.0, 0.01, 0.33, 0.5, 0.66, 0.9, 0.999, 1.0]
    for bins in ((2, 2), (100, 16), (65_536, 4_096)):
        got = ordering.exact_percentiles(df, {"v": shares, "w": shares}, *bins)
        for column, own in (("v", values), ("w", -values)):
            row = spark.range(1).select(got[column]).first()[0]
            assert np.allclose(row, np.percentile(own, [s * 100 for s in shares]), rtol=1e-12)


def test_percentiles_of_one_value_and_infinities(spark):
    one = spark.createDataFrame([(3.5,), (None,)], "v double")
    assert spark.range(1).select(ordering.exact_percentiles(one, {"v": [0.1, 1.0]})["v"]).first()[0] == [3.5, 3.5]
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "v double")
    got = spark.range(1).select(ordering.exact_percentiles(ends, {"v": [0.0, 0.5, 1.0]})["v"]).first()[0]
    assert got == [float("-inf"), 1.0, float("inf")]


@pytest.mark.parametrize("n", [1, 9, 10, 25, 101])
def test_equal_count_buckets(spark, n):
    got = [
        r[0]
        for r in spark.range(1, n + 1)
        .select("id", ordering.equal_count_bucket(F.col("id"), F.lit(n)).alias("b"))
        .orderBy("id").select("b").collect()
    ]
    if n == 1:
        assert got == [1]
    else:
        assert got == (pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False) + 1).tolist()
    assert got == sorted(got)


def test_top_k(spark):
    rows = [("a", 1.0, "x", "u"), ("a", 3.0, "y", ""), ("a", 3.0, "w", None), ("a", 2.0, "z", "u"), ("b", None, "q", "u")]
    df = spark.createDataFrame(rows, "g string, s double, id string, url string")
    top = ordering.top_k(df, "g", "s", ["id"], 2)
    assert sorted(r["id"] for r in top.collect()) == ["q", "w", "y"]
    kept = ordering.top_k(df, "g", "s", ["id"], 1, filled="url")
    assert sorted(r["id"] for r in kept.collect()) == ["q", "z"]
    low = ordering.top_k(df, "g", "s", ["id"], 1, ascending=True)
    assert sorted(r["id"] for r in low.collect()) == ["q", "x"]
    with pytest.raises(KeyError):
        ordering.top_k(df, "g", "s", ["id"], 1, filled="file_url")


def test_top_k_cuts_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id AS s", "id")
    plan = ordering.top_k(df, "g", "s", ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_sample_is_repeatable(spark):
    df = spark.range(10_000)
    first = {r[0] for r in ordering.sample_share(df, "id", 0.1, 3).collect()}
    assert 850 < len(first) < 1150
    assert first == {r[0] for r in ordering.sample_share(df.repartition(9), "id", 0.1, 3).collect()}
    assert first != {r[0] for r in ordering.sample_share(df, "id", 0.1, 4).collect()}


def test_percent_ranks_over_block_borders_and_null_groups(spark):
    rows = [(g, v, i) for i, (g, v) in enumerate([("hot", v) for v in [5.0] * 40 + [3.0, None] * 20] + [(None, 1.0), (None, 2.0), ("one", None)])]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(7)
    got = {r["id"]: r["r"] for r in ordering.percent_ranks(df, "g", "v", "r", ["id"], 9).collect()}
    assert len(got) == len(rows)
    assert got == {r["id"]: r["r"] for r in ordering.percent_ranks(df, "g", "v", "r", ["id"]).collect()}
    for g, v, i in rows:
        own = [w for h, w, _ in rows if h == g]
        before = sum(w is not None and (v is None or w > v) for w in own)
        assert got[i] == (0.0 if len(own) == 1 else before / (len(own) - 1))
