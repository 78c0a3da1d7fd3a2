"""Label parsing on good and broken texts, story ranking and consolidation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.operators import labels, places

CASES = [
    # text, field values expected, path
    ("{'short_description': 'A', 'keywords': ['red fox', 'BLUE'], 'virality_potential': '12%'}",
     {"short_description": "A", "keywords": "Red Fox, Blue", "virality_potential": 12.0, "event_type": ""}, "literal"),
    ("{'short description': 'A', 'viral_potential': '~0.8', 'keywords': 'a b, c'}",
     {"short_description": "A", "virality_potential": 0.8, "keywords": "A B, C"}, "literal"),
    ('{"long_description": "It\'s fine", "event_type": None, "place_id": 12}',
     {"long_description": "It's fine", "event_type": "", "place_id": "12"}, "literal"),
    ("{'short_description': 'Mood: None, really', 'event_scale': None}",
     {"short_description": "Mood: None, really", "event_scale": ""}, "literal"),
    ("{'short_description': 'it\\'s', 'consistency': 0.5}",
     {"short_description": "it's", "consistency": 0.5}, "literal"),
    ("  {'place_id': ' x ', 'detection_start_time': '2024-01-02 03:04:05', 'detection_end_time': 'soon'}  ",
     {"place_id": "x", "detection_start_time": dt.datetime(2024, 1, 2, 3, 4, 5), "detection_end_time": None}, "literal"),
    ("{'place_id': 'p1', 'detection_start_time': Timestamp('2024-01-02 00:00:00'), 'viralityPotential': '0.7'}",
     {"place_id": "p1", "detection_start_time": dt.datetime(2024, 1, 2), "virality_potential": 0.7}, "pattern"),
    ("{'event_type': sports, 'short description': 'A b', 'key_objects': ['one two', \"three\"",
     {"event_type": "sports", "short_description": "A b", "key_objects": "One Two, Three"}, "pattern"),
    ("{'activity_type': 'run, jump', 'virality_potential': -0.25 oops",
     {"activity_type": "Run, Jump", "virality_potential": -0.25}, "pattern"),
    ("{\"event_scale\": null}", {"event_scale": "null"}, "pattern"),
    ("not a dict", {"short_description": "", "virality_potential": 0.0, "detection_start_time": None}, "pattern"),
    ("", {"short_description": "", "keywords": ""}, "empty"),
    (None, {"event_type": "", "consistency": 0.0, "place_id": ""}, "empty"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, labels string")
    return {r["i"]: r for r in labels.parse(df, "labels").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_parse(parsed, i):
    _, want, path = CASES[i]
    assert parsed[i]["parse_path"] == path
    for field, value in want.items():
        assert parsed[i][field] == value, field
    for field in fixed.LABEL_TEXT_FIELDS + fixed.LABEL_LIST_FIELDS + fixed.LABEL_NUMBER_FIELDS:
        assert parsed[i][field] is not None


def test_long_text_is_read_whole(spark):
    body = "word, " * 20_000
    text = "{'short_description': '" + body + "', 'keywords': ['" + "', '".join(f"k{i}" for i in range(5000)) + "'], 'event_scale': None}"
    df = spark.createDataFrame([(text,), (text[:-30],)], "labels string")
    rows = labels.parse(df, "labels").collect()
    assert {r["parse_path"] for r in rows} == {"literal", "pattern"}
    for r in rows:
        assert r["short_description"].strip() == body.strip()
        assert r["keywords"].startswith("K0, K1") and r["keywords"].count(",") > 4990


def test_required_fields_only(spark):
    df = spark.createDataFrame([("{}",)], "labels string")
    assert labels.parse(df, "labels", fixed.PLACE_LABEL_FIELDS).columns == ["labels", *fixed.PLACE_LABEL_FIELDS, "parse_path"]
    with pytest.raises(ValueError):
        labels.parse(df, "labels", ["mood"])


def test_texts_go_through_python_once(spark):
    df = spark.createDataFrame([("{}", 1)], "labels string, i int")
    plan = labels.parse(df, "labels")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


@pytest.fixture(scope="module")
def scored(spark):
    time = dt.datetime(2024, 1, 10)
    base = ("Europe", "North America", None, "p1", "Place", "R", "C")
    rows = [(*base, f"s{i}", f"l{i}", None, time + dt.timedelta(hours=i), 1.0, v) for i, v in enumerate([5, 5, 1, None])]
    rows.append(("Asia", "Elsewhere", "K", "p2", "Other", "R", "C", "s9", "l9", None, time, 1.0, 3))
    stories = spark.createDataFrame(
        rows,
        ", ".join(f"{c} string" for c in places.STORY_KEYS) + ", event_time timestamp_ntz, time_viewed_total_day double, views_total_day bigint",
    )
    media_rows = [(f"s{i}", str(1704800000000 + i), "" if i else None, f"m{i}", dt.date(2024, 1, 10)) for i in (0, 1, 2, 3, 9)]
    media_rows.append(("s0", "1704800009999", "flat", "m", dt.date(2024, 1, 9)))
    media = spark.createDataFrame(media_rows, "story_id string, submit_ts string, flat_url string, media_url string, ds date")
    return places.story_scores(stories, media, "2024-01-10", "2024-01-10", 0.6, 0.4)


def test_story_scores(scored):
    rows = {r["story_id"]: r for r in scored.collect()}
    assert [rows[f"s{i}"]["story_views_rank"] for i in range(4)] == [0.0, 0.0, pytest.approx(2 / 3), 1.0]
    assert [rows[f"s{i}"]["story_freshness_rank"] for i in range(4)] == [0.0, 1.0, pytest.approx(2 / 3), pytest.approx(1 / 3)]
    assert rows["s1"]["score"] == pytest.approx(0.4)
    assert rows["s0"]["media_url"] == "m0" and rows["s9"]["score"] == 0.0
    assert rows["s2"]["detection_end_time"] == dt.datetime(2024, 1, 10, 3)


def test_consolidation_and_join(spark, scored):
    best = places.best_stories(places.in_regions(scored, ["North America"]), 3)
    texts = [("s2", "{'event_type': 'a', 'keywords': ['x', 'y'], 'virality_potential': 0.2, 'short_description': 'two'}"),
             ("s3", "{'event_type': 'b', 'keywords': ['y'], 'virality_potential': 0.4, 'short_description': 'three'}"),
             ("s1", "{'event_type': 'b', 'keywords': [], 'virality_potential': 0.6, 'short_description': 'one'}")]
    label_rows = spark.createDataFrame(texts, "story_id string, labels string")
    stories = places.labelled_stories(best, label_rows).withColumns({"prompt_tokens": F.lit(3), "completion_tokens": F.lit(1)})
    row = places.consolidate(stories).collect()
    assert len(row) == 1
    row = row[0]
    assert row["event_type"] == "b" and row["keywords"] == ["X", "Y"] and row["place_country_code"] is None
    assert row["short_description"] == "three | two | one" and row["most_viewed_link"] == "l1"
    assert row["virality_potential"] == pytest.approx(0.4)
    place_texts = spark.createDataFrame([("p1", "{'consistency': 0.9, 'keywords': ['z z']}")], "place_id string, labels string")
    summary = places.with_place_labels(places.consolidate(stories), place_texts)
    assert summary.first()["keywords"] == "Z Z" and summary.first()["consistency"] == 0.9
    joined = places.place_story_rows(summary, stories)
    assert joined.count() == 3 and "video_keywords" in joined.columns
    assert places.token_use(stories).first()["prompt_tokens"] == 9


def test_majority_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("g", v) for v in ("b", "a", "a", "b", None)], "g string, v string")
    assert df.groupBy("g").agg(places.majority("v").alias("m")).first()["m"] == "a"


LITERALS = [
    (r"{'short_description': 'a\x41b'}", "short_description", "aAb"),
    (r"{'short_description': 'a\qb \\x41 \'s'}", "short_description", r"a\qb \x41 's"),
    ("{'keywords': ('a b', 'c')}", "keywords", "A B, C"),
    ("{'keywords': ('a b',), 'event_type': ('x'),}", "keywords", "A B"),
    ("{'virality_potential': .5, 'event_type': 'v .5, (x) }'}", "virality_potential", 0.5),
    ("{'short_description': 'one ' 'two' ' three', 'virality_potential': 1e-3}", "virality_potential", 0.001),
    ("{'short_description': 'one ' 'two' ' three', 'virality_potential': 1e-3}", "short_description", "one two three"),
    ("{'short_description': 'a' 'b' \"c\" 'd'\n'e' 'f' 'g' 'h' 'i'}", "short_description", "abcdefghi"),
    ("{'short_description': " + "'x' " * 500 + "}", "short_description", "x" * 500),
    (r"{'short_description': 'o\101\60 \u00e9'}", "short_description", "oA0 é"),
    ("{'keywords': [['a', ('b', {'c': None})], {'d'}], 'event_type': True}", "keywords", "['A', ('B', {'C': None})], {'D'}"),
    ("{'keywords': [['a', ('b', {'c': None})], {'d'}], 'event_type': True}", "event_type", "True"),
    ("{'virality_potential': None, 'viral_potential': 0, 'viralityPotential': 5}", "virality_potential", 0.0),
    ("{'place_id': 0, 'event_type': 'x'}", "place_id", ""),
    ("{'place_id': '0'}", "place_id", "0"),
    ("{'place_id': 0, 'event_type': 'x", "place_id", ""),
    ("{'detection_start_time': '2024/01/05 10:00'}", "detection_start_time", "2024-01-05 10:00:00"),
    ("{'detection_start_time': 'Jan 5, 2024'}", "detection_start_time", "2024-01-05 00:00:00"),
]


def test_literals_that_json_writes_otherwise(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LITERALS)], "i int, t string")
    fields = sorted({name for _, name, _ in LITERALS})
    got = {r["i"]: r for r in labels.parse(rows, "t", fields).collect()}
    for i, (_, name, want) in enumerate(LITERALS):
        assert (str(got[i][name]) if name.endswith("time") else got[i][name]) == want
    assert {r["parse_path"] for i, r in got.items() if LITERALS[i][0].endswith("}")} == {"literal"}
