"""Stories per place: scores, the best few, and one consolidated row per place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import dates
from tidemark.functions import predicates as p
from tidemark.operators import labels, ordering
from tidemark.sources import tables

STORY_KEYS = (
    "continent", "inclusive_region", "place_country_code", "place_id", "place_name", "place_region",
    "place_country", "story_id", "story_link", "venue_name",
)


def media_per_story(media: DataFrame, start, end) -> DataFrame:
    """Latest submit time and media address per story, the flat address where there is one.

    Rows count from the day before the range. Stories without an address fall out.
    """
    address = F.when(F.col("flat_url") != "", F.col("flat_url")).otherwise(F.col("media_url"))
    days = tables.between_days(media, F.date_sub(dates.day(start), 1), dates.day(end))
    return (
        days.groupBy("story_id")
        .agg(
            F.max(dates.from_epoch_millis(F.col("submit_ts"))).alias("submit_ts"),
            F.max(address).alias("media_url"),
        )
        .where(p.has_text(F.col("media_url")))
    )


def place_spans(stories: DataFrame) -> DataFrame:
    """First and last detection per place id, whatever names it goes by."""
    return stories.groupBy("place_id").agg(
        F.min("event_time").alias("detection_start_time"), F.max("event_time").alias("detection_end_time")
    )


def story_scores(
    stories: DataFrame, media: DataFrame, start, end, view_weight: float = 0.7, freshness_weight: float = 0.3
) -> DataFrame:
    """Stories of the range with a media address, ranked within their place and scored.

    Ranks run from 0 for the most viewed and the newest story, so a low score
    is a good story.
    """
    # A range of times, not of dates, reaches the scan.
    after = F.date_add(dates.day(end), 1).cast("timestamp")
    days = stories.where((F.col("event_time") >= dates.day(start).cast("timestamp")) & (F.col("event_time") < after))
    each = days.groupBy(*STORY_KEYS).agg(
        F.max("time_viewed_total_day").alias("time_viewed_total_day"),
        F.max("views_total_day").alias("views_total_day"),
    )
    spans = place_spans(days).withColumnRenamed("place_id", "_place")
    found = each.join(media_per_story(media, start, end), "story_id")
    # A story of no place is kept: NULL is a place of its own.
    found = found.join(spans, found["place_id"].eqNullSafe(spans["_place"]), "left").drop("_place")
    unique = ["story_id", "place_name"]
    ranked = ordering.percent_ranks(found, "place_id", "views_total_day", "story_views_rank", unique)
    ranked = ordering.percent_ranks(ranked, "place_id", "submit_ts", "story_freshness_rank", unique)
    score = F.col("story_views_rank") * view_weight + F.col("story_freshness_rank") * freshness_weight
    return ranked.withColumn("score", score)


def in_regions(stories: DataFrame, regions: Sequence[str]) -> DataFrame:
    return stories.where(F.col("inclusive_region").isin(list(regions)))


def best_stories(
    scored: DataFrame, k: int = 5, ascending: bool = False, filled: str | None = None
) -> DataFrame:
    """The k first stories of each place by score, the highest first unless asked otherwise."""
    return ordering.top_k(scored, "place_id", "score", ["story_id"], k, ascending, filled)


def labelled_stories(stories: DataFrame, story_labels: DataFrame) -> DataFrame:
    """Stories with their parsed label; a story without one keeps the defaults."""
    return labels.parse(stories.join(story_labels, "story_id", "left"), "labels", fixed.STORY_LABEL_FIELDS)


def distinct_tokens(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct tokens of comma-separated texts per group, made distinct before they are gathered."""
    lists = [F.struct(F.lit(c).alias("_field"), F.split(F.nullif(F.col(c), F.lit("")), ", ").alias("_list")) for c in columns]
    tokens = df.select(group, F.inline(F.array(*lists))).select(group, "_field", F.explode("_list").alias("_token"))
    own = lambda c: F.collect_list(F.when(F.col("_field") == c, F.col("_token")))
    return tokens.distinct().groupBy(group).agg(*[F.array_sort(own(c)).alias(c) for c in columns])


def joined_text(column: str, order: Sequence[str]) -> Column:
    """Non-null texts of a group, in order, joined by ' | '."""
    return F.expr(f"listagg({column}, ' | ') WITHIN GROUP (ORDER BY {', '.join(order)})")


def majority(column: str) -> Column:
    """Most frequent non-null value; the smallest of several."""
    return F.mode(F.col(column), True)


def attribute_of_best(attribute: str, rank: str, tie: str) -> Column:
    """Attribute of the row with the greatest rank; the smallest tie key of several."""
    lead = F.when(F.col(rank).isNotNull(), F.struct(-F.col(rank), F.col(tie)))
    return F.min_by(attribute, lead)


def consolidate(stories: DataFrame) -> DataFrame:
    """One row per place from its labelled best stories.

    Reads the few stories kept per place, so the lists built per group are short.
    Attributes are those of the first story by score.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("story_id").alias("id"))

    def first(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)

    heads = [k for k in fixed.PLACE_STORY_KEYS if k != "place_id"]
    tokens = distinct_tokens(stories, "place_id", fixed.LABEL_LIST_FIELDS).withColumnRenamed("place_id", "_place")
    places = stories.groupBy("place_id").agg(
        *[first(c) for c in heads],
        F.avg("virality_potential").alias("virality_potential"),
        *[majority(c).alias(c) for c in fixed.PLACE_VOTE_FIELDS],
        *[
            joined_text(c, ["score DESC", "story_id"]).alias(c)
            for c in ("short_description", "long_description")
        ],
        attribute_of_best("story_link", "views_total_day", "story_id").alias("most_viewed_link"),
    )
    joined = places.join(tokens, places["place_id"].eqNullSafe(tokens["_place"]), "left").drop("_place")
    none = F.array().cast("array<string>")
    return joined.withColumns({c: F.coalesce(c, none) for c in fixed.LABEL_LIST_FIELDS})


def token_use(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Prompt and completion tokens spent."""
    return rows.groupBy(*by).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )


def with_place_labels(places: DataFrame, place_labels: DataFrame) -> DataFrame:
    """Replace the merged texts of a place by the fields of its own label text."""
    replaced = [c for c in fixed.PLACE_LABEL_FIELDS if c in places.columns]
    texts = places.drop(*replaced).join(place_labels, "place_id", "left")
    return labels.parse(texts, "labels", fixed.PLACE_LABEL_FIELDS)


def place_story_rows(places: DataFrame, stories: DataFrame, prefix: str = "video_") -> DataFrame:
    """Each place with its stories, whose label columns get a prefix; NULL keys match NULL keys."""
    own = stories.withColumnsRenamed({c: f"{prefix}{c}" for c in fixed.STORY_LABEL_FIELDS})
    keys = fixed.PLACE_STORY_KEYS
    own = own.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for key in keys:
        same = same & places[key].eqNullSafe(own[f"_{key}"])
    return places.join(own, same, "left").drop(*[f"_{k}" for k in keys])
