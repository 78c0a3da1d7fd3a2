"""Audience properties, dated tables, views, per-day runs."""

import datetime as dt
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import audience as op
from tidemark.operators import calibration, campaigns
from tidemark.plans import audience as plan
from tidemark.plans import audience_queries, daily, weekly
from tidemark.plans.specs import AudienceSpec, CampaignSpec, LookBack
from tidemark.sources import catalog, roles, tables

SF_DIR = "/root/testdata/sf0.001"
RUN = roles.RUN_DATE


@pytest.fixture(scope="module")
def role(spark):
    return audience_queries.role_tables(spark, SF_DIR)


def found(spec, role):
    return {r[0] for r in plan.build(spec, role, RUN, roles.PAGE_CLICK_RULES).select("user_id").collect()}


OPTIONS = {
    "locale": "EN", "l90": (">=", 1), "minimum_version": 3.0, "device_type": "IOS", "age": (20, 50),
    "creator_tier": "Intermediate+", "subscriber": True, "country_text": "NATION_1,NATION_2,NATION_3",
    "region_text": "asia,africa", "member": False, "opened": LookBack(5, 1), "clicked": LookBack(9),
    "bounced_days": 1, "exclude_listed": True, "exclude_pushed_not_viewed": True, "usage_min_days": 4,
}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    base=st.sets(st.sampled_from(sorted(OPTIONS)), max_size=2),
    extra=st.sampled_from(sorted(OPTIONS)),
    kind=st.sampled_from(["email", "broadcast- recurring"]),
)
def test_a_filter_only_takes_users_away(role, base, extra, kind):
    less = {k: OPTIONS[k] for k in base}
    assert found(AudienceSpec(kind=kind, **less, **({} if extra in less else {extra: OPTIONS[extra]})), role) <= found(
        AudienceSpec(kind=kind, **less), role
    )


def test_members_and_non_members_part_the_cohort(role):
    everyone = found(AudienceSpec(), role)
    members, others = found(AudienceSpec(member=True), role), found(AudienceSpec(member=False), role)
    assert members | others == everyone and not members & others


def test_filters_that_are_off_are_not_in_the_plan(role):
    text = plan.build(AudienceSpec(kind="email"), role, RUN)._jdf.queryExecution().optimizedPlan().toString()
    assert "orders" not in text and "o_custkey" not in text and text.count("Join") == 2


def test_look_back_bounds_and_null_counters(spark):
    day = dt.date(2024, 1, 28)
    touches = spark.createDataFrame(
        [("in", day - dt.timedelta(3), 1, None), ("edge", day - dt.timedelta(1), None, 2), ("late", day, 1, 1),
         ("early", day - dt.timedelta(4), 1, 1), ("none", day - dt.timedelta(2), 0, None)],
        "user_id string, ds date, campaign_open long, transactional_open long",
    )
    assert {r[0] for r in op.openers(touches, RUN, LookBack(3, 1)).collect()} == {"in", "edge"}


def test_exclusion_is_met_on_the_inner_id(spark):
    role = {
        "cohort": spark.createDataFrame([("1", dt.date(2024, 1, 28)), ("2", dt.date(2024, 1, 28))], "user_id string, ds date"),
        "exclusion": spark.createDataFrame([("1",), ("1",)], "user_id string"),
        "id_map": spark.createDataFrame([("1", "m1"), ("2", "m2"), ("2", "m2b")], "internal_id string, user_id string"),
    }
    assert found(AudienceSpec(exclude_listed=True), role) == {"m2", "m2b"}


def test_pushed_not_viewed_bounds(spark):
    rows = [("a", 5, None, 0), ("b", 4, 0, 0), ("c", 9, 1, None)]
    pushes = spark.createDataFrame(rows, "user_id string, push_success_30d long, viewed_30d long, chat_viewed_30d long")
    assert [r[0] for r in op.pushed_not_viewed(pushes).collect()] == ["a"]


# --- tables ------------------------------------------------------------------------------


def test_dated_audience_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "audience")
    spec = AudienceSpec(kind="email")
    for day, users in (("2024-01-27", ["a", "b"]), (RUN, ["c"]), (RUN, ["d", "a"])):
        frame = spark.createDataFrame([(u,) for u in users], "user_id string")
        plan.write(frame, spec, path, day)
    stored = spark.read.parquet(path)
    assert sorted(r[0] for r in plan.current(stored, RUN).collect()) == ["a", "d"]
    assert sorted(r[0] for r in plan.current(stored, RUN, all_days=True).collect()) == ["a", "b", "d"]
    plan.register_view(stored, "audience_now", RUN)
    assert tables.row_count(spark.table("audience_now")).first()[0] == 2
    text = tables.scan_day(spark, path, RUN)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ds" in text
    assert tables.scan_days(spark, path, "2024-01-27", "2024-01-27").count() == 2
    plan.write(frame, AudienceSpec(), str(tmp_path / "plain"), RUN)
    assert "ds" not in spark.read.parquet(str(tmp_path / "plain")).columns


def test_arm_view(spark):
    stored = spark.createDataFrame(
        [("a", "treatment", dt.date(2024, 1, 28)), ("b", "control", dt.date(2024, 1, 28))],
        "user_id string, group_assignment string, ds date",
    )
    assert [r[0] for r in plan.current(stored, RUN, arm="treatment").collect()] == ["a"]


@pytest.fixture(scope="module")
def tide(spark, tmp_path_factory):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS tide LOCATION '{tmp_path_factory.mktemp('tide')}/db'")
    return "tide"


def test_catalog_table_is_swapped_and_dropped(spark, tide):
    frame = spark.createDataFrame([("a", dt.date(2024, 1, 1))], "user_id string, ds date")
    catalog.replace(frame, "tide.audience")
    # The table may be read by the job that replaces it.
    for rows in (2, 4, 8):
        now = spark.table("tide.audience")
        catalog.replace(now.union(now), "tide.audience", dated=True)
        assert spark.table("tide.audience").count() == rows
    assert len(catalog.versions(spark, "tide.audience")) == 2
    broken = frame.withColumn("user_id", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(Exception, match="stopped"):
        catalog.replace(broken, "tide.audience")
    assert spark.table("tide.audience").count() == 8 and len(catalog.versions(spark, "tide.audience")) == 2
    catalog.drop(spark, "tide.audience")
    assert not spark.catalog.tableExists("tide.audience") and not catalog.versions(spark, "tide.audience")


def test_plain_table_keeps_its_rows_when_the_job_fails(spark, tmp_path):
    path = str(tmp_path / "plain")
    tables.replace_table(spark.range(3), path)
    with pytest.raises(Exception, match="stopped"):
        tables.replace_table(spark.range(9).select(F.raise_error(F.lit("stopped")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    tables.replace_table(spark.read.parquet(path).union(spark.range(1)), path)
    assert spark.read.parquet(path).count() == 4 and os.listdir(tmp_path) == ["plain"]


def test_bucketed_roles_join_without_a_shuffle(spark, role, tide):
    names = ("cohort", "identity", "activity", "email_touch")
    made = catalog.stored(spark, {n: (lambda n=n: role[n]) for n in names}, "tide.role", "user_id", buckets=4)
    spec = AudienceSpec(kind="email", locale="EN", l90=(">=", 1), opened=LookBack(20, 0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = plan.build(spec, made, RUN)
        text = built._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and text.count("SortMergeJoin") == 3
        assert text.count("PartitionFilters: [isnotnull(ds") == 4 and "Bucketed: true" in text
        assert sorted(built.collect()) == sorted(plan.build(spec, role, RUN).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name in names:
        catalog.drop(spark, f"tide.role_{name}")


def test_run_dates_prune_when_the_query_runs(spark, tide):
    rows = [(u, dt.date(2024, 1, d)) for d in range(20, 29) for u in ("a", f"u{d}")]
    catalog.replace(spark.createDataFrame(rows, "user_id string, ds date"), "tide.listed", dated=True)
    for day in (21, 28):
        dated = spark.createDataFrame([("audience", dt.date(2024, 1, day)), ("other", dt.date(2024, 1, 20))], "job string, ds date")
        catalog.replace(dated, "tide.run_dates")
        plan.lasting_view(spark, "tide.now", "tide.listed", "tide.run_dates")
        now = spark.table("tide.now")
        assert sorted(r[0] for r in now.collect()) == ["a", f"u{day}"]
        assert "dynamicpruning" in now._jdf.queryExecution().executedPlan().toString()
        found = catalog.with_run_date(spark.table("tide.listed"), spark.table("tide.run_dates"), "audience")
        assert found.count() == 2
    plan.lasting_view(spark, "tide.ever", "tide.listed")
    assert spark.table("tide.ever").count() == 10
    assert spark.table("tide.listed").where(catalog.today_condition("America/Los_Angeles", 2)).count() == 0
    for name in ("now", "ever"):
        spark.sql(f"DROP VIEW tide.{name}")
    for name in ("listed", "run_dates"):
        catalog.drop(spark, f"tide.{name}")


def test_only_missing_days_run_and_empty_ones_are_marked(spark, tmp_path):
    days = spark.createDataFrame(
        [("x", dt.date(2025, 7, d), i) for d in (1, 3, 4, 6) for i in range(3)], "id string, ds date, v int"
    )
    days.write.partitionBy("ds").parquet(str(tmp_path / "in"))
    source, path, ran = spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), []

    def per_day(rows):
        ran.append(sorted(f.split("ds=")[1][:10] for f in rows.inputFiles()))
        text = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [ds" in text or "PartitionFilters: [isnotnull(ds" in text
        return rows.groupBy("ds").agg(F.sum("v").alias("v"))

    as_text = lambda found: [str(d) for d in found]
    assert as_text(daily.run_missing(source, "2025-07-01", "2025-07-03", per_day, path)) == ["2025-07-01", "2025-07-02", "2025-07-03"]
    assert sorted(os.listdir(tmp_path / "out" / "_empty")) == ["ds=2025-07-02"]
    first = {r["ds"] for r in spark.read.parquet(path).collect()}
    assert {str(d) for d in first} == {"2025-07-01", "2025-07-03"}
    assert daily.run_missing(source, "2025-07-01", "2025-07-03", per_day, path) == [] and len(ran) == 1
    assert as_text(daily.run_missing(source, "2025-07-02", "2025-07-06", per_day, path)) == ["2025-07-04", "2025-07-05", "2025-07-06"]
    assert spark.read.parquet(path).agg(F.sum("v")).first()[0] == 12 and len(ran) == 2
    read = [r["f"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(read) == 4


def test_weeks_from_stored_days_equal_a_full_run(spark, tmp_path):
    facts, path = roles.ad_facts(spark, SF_DIR), str(tmp_path / "days")
    first = weekly.store_days(facts, "1997-01-01", "1997-03-31", path)
    more = weekly.store_days(facts, "1997-03-01", "1997-05-02", path)
    texts = lambda found: [tuple(map(str, x)) for x in found]
    assert texts(first) == [("1997-01-01", "1997-03-31")] and texts(more) == [("1997-04-01", "1997-05-02")]
    before = weekly.store_days(facts, "1996-12-30", "1997-05-03", path)
    assert texts(before) == [("1996-12-30", "1996-12-31"), ("1997-05-03", "1997-05-03")]
    assert weekly.store_days(facts, "1996-12-30", "1997-05-03", path) == []
    os.remove(f"{path}/run=1997-05-03_1997-05-03/_SUCCESS")
    assert texts(weekly.store_days(facts, "1997-05-01", "1997-05-03", path)) == [("1997-05-03", "1997-05-03")]
    got = calibration.weekly_overall(weekly.weeks(spark, path, "1997-01-01", "1997-05-02"))
    want = calibration.weekly_overall(calibration.traffic(facts, "1997-01-01", "1997-05-02", "week"))
    pick = ["week", "conversions", "revenue", "rev_sla"]
    for g, w in zip(got.select(pick).orderBy("week").collect(), want.select(pick).orderBy("week").collect(), strict=True):
        assert g["week"] == w["week"] and [float(x) for x in g[1:]] == pytest.approx([float(x) for x in w[1:]])


def test_per_day_run_and_csv(spark, tmp_path):
    source = spark.createDataFrame(
        [("x", dt.date(2025, 7, d), i) for d in (1, 1, 3, 4) for i in range(3)], "id string, ds date, v int"
    )
    path = str(tmp_path / "days")
    counts = daily.run_days(source, "2025-07-01", "2025-07-03", lambda df: df.withColumn("w", F.col("v") + 1), path, 2)
    assert {str(r["ds"]): r["rows"] for r in counts.collect()} == {"2025-07-01": 6, "2025-07-03": 3}
    daily.csv_per_day(spark.read.parquet(path), str(tmp_path / "csv"))
    assert sorted(n for n in os.listdir(tmp_path / "csv") if n.startswith("ds=")) == ["ds=2025-07-01", "ds=2025-07-03"]
    tables.write_csv(source, str(tmp_path / "one"))
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).count() == 12


# --- campaigns -----------------------------------------------------------------------------


def test_campaign_edges(spark):
    rows = [
        (dt.datetime(2023, 12, 31), "C1", "S", "IMPRESSION", 100), (dt.datetime(2023, 12, 31), "", "S", "CLICK", 9),
        (dt.datetime(2024, 1, 1), "c1", "S", "IMPRESSION", 150), (dt.datetime(2024, 3, 31), "N", "S", "CLICK", 30),
        (dt.datetime(2024, 3, 31), "N", "T", "SHARE", 30), (dt.datetime(2024, 4, 1), "C1", "S", "CLICK", 5),
    ]
    daily_rows = spark.createDataFrame(rows, "ts timestamp_ntz, campaign_id string, surface string, action string, action_cnt long")
    spec = CampaignSpec(dt.date(2024, 3, 31), 1)
    kept = campaigns.campaign_rows(daily_rows.withColumn("ds", F.to_date("ts")), spec)
    summary = {r["quarter"]: r for r in campaigns.quarter_summary(kept).collect()}
    assert summary["2023Q4"]["impression_count_qoq"] == 0.0
    assert summary["2024Q1"]["impression_count_qoq"] == 50.0 and summary["2024Q1"]["campaign_count"] == 2
    assert [r[0] for r in campaigns.new_campaigns(kept, "2024Q1").collect()] == ["N"]
    change = campaigns.action_change(kept, campaigns.quarters_between(spec)).where("action = 'CLICK'").first()
    assert change["2024Q1_qoq_change"] == 0.0
    rates = {r["campaign_id"]: r for r in campaigns.campaign_rates(kept, "2024Q1").collect()}
    assert rates["N"]["campaign_ctr"] is None and rates["c1"]["campaign_ctr"] == 0.0
    assert rates["c1"]["overall_ctr"] == 0.2
    assert {r["campaign_id"] for r in campaigns.top_and_bottom(campaigns.campaign_rates(kept, "2024Q1")).collect()} == {"c1"}


def test_frequency_bounds(spark):
    rows = [("q", "a", i, u, 1, 0) for i, u in ((0, 500), (1, 100), (1, 101), (15, 101), (16, 101))]
    df = spark.createDataFrame(rows, "quarter string, campaign_id string, impression int, uu long, total_click long, total_dismiss long")
    got = campaigns.frequency_efficiency(df, "a").collect()
    assert sorted((r["impression"], r["uu"]) for r in got) == [(1, 101), (15, 101)]


def test_opened_and_not_bounced_is_one_scan(spark, tmp_path):
    rows = [("a", "2024-01-28", 1, 0), ("b", "2024-01-28", 1, 0), ("b", "2024-01-27", 0, 1), ("c", "2024-01-20", 1, 1), ("d", "2024-01-27", 0, 0), ("e", "2024-01-01", 1, 0)]
    schema = "user_id string, ds string, campaign_open long, campaign_bounce long"
    touches = spark.createDataFrame(rows, schema).withColumn("ds", F.col("ds").cast("date"))
    touches = touches.withColumns({c: F.lit(None).cast("long") for c in ("transactional_open", "transactional_bounce", "campaign_unsubscribe", "transactional_unsubscribe")})
    touches.write.partitionBy("ds").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = op.openers_without_bounce(stored, "2024-01-28", LookBack(10, 0), 1)
    planned = found._jdf.queryExecution().executedPlan().toString()
    assert planned.count("FileScan") == 1 and "PartitionFilters: [isnotnull(ds" in planned
    assert sorted(r[0] for r in found.collect()) == ["a", "c"]
