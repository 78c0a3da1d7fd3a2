"""Registered story and label queries over the role views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import text as tx
from tidemark.operators import labels, ordering
from tidemark.operators import places as op
from tidemark.plans import daily
from tidemark.plans.calibration_queries import rounded
from tidemark.sources import roles, tables

START, END, DAY = "2024-01-05", "2024-01-25", "2024-01-14"
REGIONS = ("North America",)


def _scores(spark, sf_dir):
    return op.story_scores(roles.stories(spark, sf_dir), roles.story_media(spark, sf_dir), START, END)


def story_scores(spark, sf_dir):
    scored = _scores(spark, sf_dir)
    spans = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("detection_start_time", "detection_end_time")]
    return rounded(
        scored.select(
            "place_id", "place_name", "story_id", "venue_name", "media_url", "time_viewed_total_day",
            "views_total_day", "story_views_rank", "story_freshness_rank", "score", *spans,
        ),
        9,
    )


def _best(spark, sf_dir):
    return op.best_stories(op.in_regions(_scores(spark, sf_dir), REGIONS))


def story_topk(spark, sf_dir):
    return rounded(_best(spark, sf_dir).select("place_id", "story_id", "score"), 9)


def story_topk_lowest(spark, sf_dir):
    best = op.best_stories(_scores(spark, sf_dir), k=3, ascending=True, filled="venue_name")
    return rounded(best.select("place_id", "story_id", "venue_name", "score"), 9)


def label_parse(spark, sf_dir):
    parsed = labels.parse(roles.part_labels(spark, sf_dir), "labels")
    return rounded(
        parsed.select(
            "p_partkey", "short_description", "event_type", "event_scale", "keywords", "key_objects", "place_id",
            "virality_potential", "consistency", "parse_path",
            F.date_format("detection_start_time", "yyyy-MM-dd").alias("detection_start"),
        )
    )


def _labelled(spark, sf_dir):
    return op.labelled_stories(_best(spark, sf_dir), roles.story_labels(spark, sf_dir))


def place_consolidated(spark, sf_dir):
    places = op.consolidate(_labelled(spark, sf_dir))
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("detection_start_time", "detection_end_time")}
    lists = {c: F.array_join(c, ", ") for c in fixed.LABEL_LIST_FIELDS}
    return rounded(places.withColumns({**times, **lists}))


def place_story_join(spark, sf_dir):
    stories = ordering.settle(_labelled(spark, sf_dir))
    places = op.consolidate(stories).select(*fixed.PLACE_STORY_KEYS, "event_type")
    rows = op.place_story_rows(places, stories)
    return rounded(
        rows.select("place_id", "place_name", "event_type", "story_id", "video_event_type", "video_short_description", "score"),
        9,
    )


def file_endings(spark, sf_dir):
    """Stories by the file ending of their content type."""
    typed = roles.story_content(spark, sf_dir).withColumn("ending", tx.file_ending(F.col("content_type")))
    return typed.groupBy("ending").agg(F.count("*").alias("stories"))


def place_labels(spark, sf_dir):
    """Consolidated places with the fields of their own label text in place of the merged ones."""
    places = op.with_place_labels(op.consolidate(_labelled(spark, sf_dir)), roles.place_labels(spark, sf_dir))
    return rounded(
        places.select("place_id", "place_name", "event_type", "short_description", "keywords", "key_objects", "parse_path")
    )


def daily_stories(spark, sf_dir):
    """Stories per region of a range of days, written as a dated table day by day; one day is read back.

    The table lies in the shared folder until its day is read. A second run of a longer range adds the missing days.
    """
    path = f"{ordering.ensure_checkpoint_dir(spark)}/daily-{uuid.uuid4().hex}"
    per_day = lambda rows: rows.groupBy("ds", "place_region").agg(F.count("*").alias("stories"))
    stories = roles.stories(spark, sf_dir)
    daily.run_missing(stories, START, DAY, per_day, path)
    daily.run_missing(stories, START, END, per_day, path)
    day = tables.scan_day(spark, path, DAY).select(F.col("ds").cast("string").alias("ds"), "place_region", "stories")
    found = ordering.settle(day)
    tables.remove(spark, path)
    return found


def token_use(spark, sf_dir):
    return op.token_use(_labelled(spark, sf_dir), ["place_id"])


QUERIES = {
    f.__name__: f
    for f in (
        story_scores, story_topk, story_topk_lowest, label_parse, file_endings, place_labels, daily_stories, place_consolidated, place_story_join, token_use,
    )
}
