"""Value rules of the column helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import alpha, dates, normal, numbers, predicates as p, text
from tidemark.plans.specs import AudienceSpec, CampaignSpec, LookBack, experiment_kind, tiers_for


def values(spark, rows, schema, column):
    frame = spark.createDataFrame(rows, schema)
    return [r[0] for r in frame.select(column.alias("out")).collect()]


def test_ratio_over_zero_is_null_or_zero(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (None, 1.0)]
    assert values(spark, rows, "a double, b double", numbers.ratio(F.col("a"), F.col("b"))) == [0.5, None, None]
    assert values(spark, rows, "a double, b double", numbers.ratio_or_zero(F.col("a"), F.col("b"))) == [0.5, 0.0, 0.0]


def test_half_even(spark):
    assert values(spark, [(0.125,), (0.375,)], "a double", numbers.half_even(F.col("a"), 2)) == [0.12, 0.38]


def test_percent_text_round_trip(spark):
    out = values(spark, [(0.0125,)], "a double", numbers.percent_value(numbers.percent_text(F.col("a"))))
    assert out == [pytest.approx(0.0125)]
    assert values(spark, [("n/a",)], "a string", numbers.percent_value(F.col("a"))) == [None]
    shown = values(spark, [(1.0,)], "a double", numbers.interval_text(F.col("a"), F.col("a") - 1, F.col("a") + 1))
    assert shown == ["1.000 (0.000, 2.000)"]


def test_country_text_match(spark):
    rows = [("US",), ("",), (None,), ("S,C",), ("FR",)]
    out = values(spark, rows, "c string", p.code_in_text("US,CA", F.col("c")))
    assert out == [True, True, None, True, False]


def test_region_ignores_case(spark):
    assert values(spark, [("euRope",)], "c string", p.code_in_text("Europe", F.col("c"), True)) == [True]


def test_locale_null_drops_both_ways(spark):
    rows = [("en_US",), ("fr",), (None,)]
    assert values(spark, rows, "c string", p.locale_is_english(F.col("c"))) == [True, False, None]
    assert values(spark, rows, "c string", p.locale_is_english(F.col("c"), False)) == [False, True, None]


def test_version(spark):
    rows = [("12.5.1",), ("12.50",), ("12",), ("x.1",), (None,)]
    assert values(spark, rows, "v string", p.version_at_least(F.col("v"), 12.4)) == [False, True, None, None, None]


def test_hygiene_nulls(spark):
    rows = [(None,), ([1, 2],), ([],), ([1],)]
    assert values(spark, rows, "a array<int>", p.no_severe_anomaly(F.col("a"))) == [True, False, True, True]
    assert values(spark, [(True,), (False,), (None,)], "b boolean", p.is_false(F.col("b"))) == [False, True, False]


@pytest.mark.parametrize(
    "goal, model, expected",
    [
        ("SWIPES", "M_7_0", "c70"), ("SWIPES", "M7x0", "c70"), ("PIXEL_VO", "M_7_0", "v70"),
        ("APP_PURCHASE", "M_7_0", "c20"), ("APP_PURCHASE_VO", "M_7_0", "v20"), ("APP_SIGNUP", "M_28_1", "c21"),
        ("APP_PURCHASE_VO", "M_28_1", "v21"), ("PIXEL_VO", "M_28_1", "v11"), ("PIXEL_BUY", "M_28_1", "c11"),
        ("SWIPES", "M_28_1", "c21"), (None, "M_7_0", "c21"), ("PIXEL_BUY", None, "c11"),
    ],
)
def test_attribution_window(spark, goal, model, expected):
    names = [("conversions_7_0", "c70"), ("conversions_2_0", "c20"), ("conversions_2_1", "c21"), ("conversions_1_1", "c11")]
    names += [(n.replace("conversions", "conversions_value"), c.replace("c", "v")) for n, c in names]
    frame = spark.range(1).select(
        F.lit(goal).cast("string").alias("optimization_goal"), F.lit(model).cast("string").alias("model_type"),
        *[F.lit(code).alias(name) for name, code in names],
    )
    assert frame.select(p.window_conversions()).first()[0] == expected


def test_any_positive_and_compare(spark):
    assert values(spark, [(None, 1), (0, None), (0, 0)], "a int, b int", p.any_positive(F.col("a"), F.col("b"))) == [True, False, False]
    assert values(spark, [(3,)], "a int", p.compare(F.col("a"), ">=", 3)) == [True]
    with pytest.raises(ValueError):
        p.compare(F.lit(1), "~", 3)


def test_click_rules_first_match_wins(spark):
    rules = [("deep_link_url", "email", "Mail"), ("deep_link_url", "reminder", "Reminder"), ("short_link_url", "aBc1", "Short")]
    rows = [("x/EMAIL/reminder", None), (None, "z/abc1"), ("none", "none")]
    assert values(spark, rows, "deep_link_url string, short_link_url string", p.click_label(rules)) == ["Mail", "Short", None]
    with pytest.raises(ValueError):
        p.click_label(())


def test_hash_arm_is_stable_and_balanced(spark):
    arms = [r[0] for r in spark.range(2000).select(p.hash_arm(F.col("id"))).collect()]
    assert arms == [r[0] for r in spark.range(2000).select(p.hash_arm(F.col("id"))).collect()]
    assert 850 < arms.count("treatment") < 1150
    fast = [r[0] for r in spark.range(2000).select(p.fast_hash_arm(F.col("id"))).collect()]
    assert 850 < fast.count("treatment") < 1150


def test_title_case_and_tokens(spark):
    assert values(spark, [("it's a-b FOO 11",)], "s string", text.title_case(F.col("s"))) == ["It'S A-B Foo 11"]
    assert values(spark, [(" a, ,b ",), (None,)], "s string", text.tokens(F.col("s"))) == [["a", "b"], []]


def test_lenient_numbers(spark):
    rows = [("12%",), ("~0.8",), ("1e3 x",), ("none",), (None,)]
    assert values(spark, rows, "s string", text.lenient_double(F.col("s"))) == [12.0, 0.8, 1000.0, 0.0, 0.0]
    assert values(spark, [("3.9",), ("x",), (None,)], "s string", text.lenient_int(F.col("s"))) == [3, 0, 0]


def test_file_endings(spark):
    rows = [("video/mp4",), ("image/jpeg",), ("image/gif",), ("text/html",)]
    assert values(spark, rows, "s string", text.file_ending(F.col("s"))) == [".mp4", ".jpg", ".png", ""]


def test_dates(spark):
    day = dt.date(2023, 6, 30)
    rows = [(day,)]
    assert values(spark, rows, "d date", dates.months_before(F.col("d"), 3)) == [dt.date(2023, 3, 30)]
    assert values(spark, rows, "d date", dates.week_start(F.col("d"))) == [dt.date(2023, 6, 26)]
    assert values(spark, rows, "d date", dates.quarter_label(F.col("d"))) == ["2023Q2"]
    assert values(spark, rows, "d date", dates.parse_day_code(dates.day_code(F.col("d"), True), True)) == [day]
    assert values(spark, [("2024-13-01",), ("2024-01-02 03:04:05",)], "s string", dates.lenient_timestamp(F.col("s"))) == [
        None, dt.datetime(2024, 1, 2, 3, 4, 5),
    ]
    late = dt.datetime(2024, 1, 3, 5, tzinfo=dt.timezone.utc)
    assert dates.default_run_date(late) == dt.date(2023, 12, 31)
    assert spark.range(1).select(dates.today_minus(2)).first()[0] is not None


def test_normal(spark):
    assert normal.two_sided_z(95) == pytest.approx(1.959963984540054)
    assert values(spark, [(0.0,), (1.96,)], "x double", normal.cdf_column(F.col("x"))) == [pytest.approx(0.5, abs=1e-7), pytest.approx(0.9750021, abs=1e-6)]
    assert alpha.z_for(0.05) == pytest.approx(1.959963984540054)
    assert alpha.obrien_fleming_alpha(100, 100, []) == pytest.approx(0.05)


def test_specs():
    assert tiers_for("Beginner") == ["2 - Beginner"]
    assert tiers_for("Advanced+") == ["5 - Advanced", "6 - Expert"]
    assert experiment_kind("AMALGAM") == "amalgam"
    for bad in (
        lambda: experiment_kind("other"), lambda: tiers_for("Guru"), lambda: LookBack(1, 2),
        lambda: AudienceSpec(age=(30, 20)), lambda: AudienceSpec(kind="fax"),
        lambda: AudienceSpec(country_single="US", country_multiple=("CA",)),
        lambda: CampaignSpec(dt.date(2024, 3, 30), 1).check(), lambda: CampaignSpec(dt.date(2023, 3, 31), 4).check(),
    ):
        with pytest.raises(ValueError):
            bad()
    spec = CampaignSpec(dt.date(2024, 12, 31), 1)
    assert (spec.quarter, spec.start_date) == ("2024Q4", dt.date(2024, 9, 30))
