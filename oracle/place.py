"""SQL of the story and label queries."""

from oracle.calibration import R
from oracle.roles import with_roles

START, END = "2024-01-05", "2024-01-25"
SCORES = f""", d AS (SELECT * FROM stories WHERE CAST(event_time AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'),
  media AS (SELECT * FROM (SELECT story_id, max(CAST(submit_ts AS BIGINT)) AS submitted,
      max(CASE WHEN flat_url <> '' THEN flat_url ELSE media_url END) AS media_url
    FROM story_media WHERE ds BETWEEN DATE '{START}' - 1 AND DATE '{END}' GROUP BY 1) WHERE media_url <> ''),
  span AS (SELECT place_id, min(event_time) AS detection_start_time, max(event_time) AS detection_end_time FROM d GROUP BY 1),
  each AS (SELECT continent, inclusive_region, place_country_code, place_id, place_name, place_region, place_country, story_id,
      story_link, venue_name, max(time_viewed_total_day) AS time_viewed_total_day, max(views_total_day) AS views_total_day FROM d GROUP BY ALL),
  ranked AS (SELECT e.*, m.media_url, s.detection_start_time, s.detection_end_time,
      percent_rank() OVER (PARTITION BY e.place_id ORDER BY views_total_day DESC NULLS LAST) AS story_views_rank,
      percent_rank() OVER (PARTITION BY e.place_id ORDER BY submitted DESC NULLS LAST) AS story_freshness_rank
    FROM each e JOIN media m ON m.story_id = e.story_id JOIN span s ON s.place_id IS NOT DISTINCT FROM e.place_id),
  scored AS (SELECT *, story_views_rank * 0.7 + story_freshness_rank * 0.3 AS score FROM ranked),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY score DESC, story_id) AS place_rank
    FROM scored WHERE inclusive_region = 'North America') WHERE place_rank <= 5)"""


def title(text: str) -> str:
    """Upper-case the first letter of each blank-separated word."""
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


def brand_title(text: str) -> str:
    return f"upper({text}[1:1]) || lower({text}[2:])"


# The label of a story, written from the source columns instead of being parsed.
LABELLED = """, l AS (SELECT b.*, e.event_type, e.user_id, e.event_id,
    CASE WHEN e.user_id % 3 = 0 THEN '' ELSE 'scale ' || (e.user_id % 3) END AS event_scale,
    (e.event_id % 10) / 10.0 AS virality
  FROM best b JOIN events e ON 's' || e.event_id = b.story_id)"""


def vote(column: str) -> str:
    """Mode with ties going to the smallest value, as count and rank."""
    return f"""(SELECT place_id, v FROM (SELECT place_id, {column} AS v, row_number() OVER (PARTITION BY place_id
      ORDER BY COUNT(*) DESC, {column}) AS r FROM l GROUP BY place_id, {column}) WHERE r = 1)"""


VOTES = {
    "event_type": "event_type",
    "event_scale": "event_scale",
    "event_duration": "'d' || (event_id % 4)",
    "event_intensity": "'i' || (event_id % 3)",
    "associated_mood": "'m' || (user_id % 5)",
}
TOKENS = {
    "keywords": f"[{title('event_type')} || ' Wave', 'User ' || (user_id % 7)]",
    "key_objects": "['Obj ' || (user_id % 4)]",
    "activity_type": "['Act ' || (event_id % 6)]",
}
ORDER = "ORDER BY score DESC, story_id"
HEADS = ("continent", "place_name", "place_country_code")


def head(column: str) -> str:
    return f"arg_min({column}, place_rank) FILTER ({column} IS NOT NULL) AS {column}"


CONSOLIDATED = f"""SELECT c.*, {', '.join(f'v_{n}.v AS {n}' for n in VOTES)} FROM (
    SELECT place_id, {', '.join(head(c) for c in HEADS)},
      strftime(min(detection_start_time), '%Y-%m-%d %H:%M:%S') AS detection_start_time,
      strftime(max(detection_end_time), '%Y-%m-%d %H:%M:%S') AS detection_end_time,
      {R('avg(virality)', 'virality_potential')},
      {', '.join(f"array_to_string(list_sort(list_distinct(flatten(list({t})))), ', ') AS {n}" for n, t in TOKENS.items())},
      '' AS contributing_context,
      string_agg('Story ' || event_id, ' | ' {ORDER}) AS short_description,
      string_agg('Seen by ' || user_id, ' | ' {ORDER}) AS long_description,
      coalesce(first(story_link ORDER BY views_total_day DESC NULLS LAST, story_id) FILTER (views_total_day IS NOT NULL), NULL) AS most_viewed_link
    FROM l GROUP BY place_id) c {' '.join(f'JOIN {vote(t)} v_{n} ON v_{n}.place_id IS NOT DISTINCT FROM c.place_id' for n, t in VOTES.items())}"""

# Which part rows carry which kind of text, straight from the source columns.
KIND = """CASE WHEN p_partkey % 5 = 1 THEN 'cut' WHEN p_partkey % 5 = 2 THEN 'stamp' WHEN p_partkey % 5 = 3 THEN 'none'
    WHEN p_partkey % 55 = 0 OR p_partkey % 65 = 0 THEN 'empty' WHEN p_partkey % 85 = 0 THEN 'plain' ELSE 'good' END"""
PART = f"""SELECT p_partkey, CASE WHEN kind IN ('empty', 'plain') THEN '' ELSE p_name END AS short_description,
    CASE WHEN kind IN ('empty', 'plain') THEN '' ELSE p_type END AS event_type, '' AS event_scale,
    CASE WHEN kind IN ('empty', 'plain') THEN '' ELSE {title('p_name')} || ', ' || {brand_title('p_brand')} END AS keywords, '' AS key_objects,
    CASE WHEN kind IN ('empty', 'plain') THEN '' ELSE 'pl' || p_size END AS place_id,
    CASE WHEN kind IN ('empty', 'plain') THEN 0.0::DOUBLE ELSE CAST('0.' || p_size AS DOUBLE) END AS virality_potential,
    0.0::DOUBLE AS consistency,
    CASE kind WHEN 'empty' THEN 'empty' WHEN 'good' THEN 'literal' WHEN 'none' THEN 'literal' ELSE 'pattern' END AS parse_path,
    CASE WHEN kind IN ('good', 'stamp') THEN strftime(DATE '2024-01-01' + p_size % 28, '%Y-%m-%d') END AS detection_start
  FROM (SELECT *, {KIND} AS kind FROM part)"""
both = ["stories", "story_media"]

SQL = {
    "story_scores": with_roles(
        both,
        SCORES + f"""SELECT place_id, place_name, story_id, venue_name, media_url, {R('time_viewed_total_day', 'time_viewed_total_day', 9)},
        views_total_day, {R('story_views_rank', 'story_views_rank', 9)}, {R('story_freshness_rank', 'story_freshness_rank', 9)}, {R('score', 'score', 9)},
        strftime(detection_start_time, '%Y-%m-%d %H:%M:%S') AS detection_start_time,
        strftime(detection_end_time, '%Y-%m-%d %H:%M:%S') AS detection_end_time FROM scored""",
    ),
    "story_topk": with_roles(both, SCORES + f"SELECT place_id, story_id, {R('score', 'score', 9)} FROM best"),
    "story_topk_lowest": with_roles(
        both,
        SCORES + f"""SELECT place_id, story_id, venue_name, {R('score', 'score', 9)} FROM (SELECT *, row_number() OVER (
        PARTITION BY place_id ORDER BY score, story_id) AS r FROM scored WHERE venue_name <> '') WHERE r <= 3""",
    ),
    "label_parse": PART,
    "file_endings": """SELECT CASE event_id % 6 WHEN 0 THEN '.mp4' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 4 THEN '.png'
        ELSE '' END AS ending, COUNT(*) AS stories FROM events GROUP BY 1""",
    "daily_stories": with_roles(
        ["stories"],
        "SELECT CAST(ds AS VARCHAR) AS ds, place_region, COUNT(*) AS stories FROM stories WHERE ds = DATE '2024-01-14' GROUP BY 1, 2",
    ),
    "place_labels": with_roles(
        both,
        SCORES + LABELLED + f""", c AS ({CONSOLIDATED})
        SELECT place_id, place_name, event_type, CASE WHEN place_id IS NULL THEN '' ELSE 'About ' || place_id[2:] END AS short_description,
          CASE WHEN place_id IS NULL THEN '' WHEN CAST(place_id[2:] AS INTEGER) % 4 = 0 THEN ''
            ELSE 'Word ' || (CAST(place_id[2:] AS INTEGER) % 7) || ', More' END AS keywords,
          CASE WHEN place_id IS NULL THEN '' ELSE 'Thing ' || (CAST(place_id[2:] AS INTEGER) % 3) END AS key_objects,
          CASE WHEN place_id IS NULL THEN 'empty' WHEN CAST(place_id[2:] AS INTEGER) % 4 = 0 THEN 'pattern' ELSE 'literal' END AS parse_path
        FROM c""",
    ),
    "place_consolidated": with_roles(both, SCORES + LABELLED + CONSOLIDATED),
    "place_story_join": with_roles(
        both,
        SCORES + LABELLED + f""", c AS ({CONSOLIDATED}), h AS (SELECT place_id, {', '.join(head(c) for c in HEADS)} FROM l GROUP BY 1)
        SELECT c.place_id, c.place_name, c.event_type, l.story_id, l.event_type AS video_event_type,
          CASE WHEN l.story_id IS NOT NULL THEN 'Story ' || l.event_id END AS video_short_description, {R('l.score', 'score', 9)}
        FROM c JOIN h ON h.place_id IS NOT DISTINCT FROM c.place_id LEFT JOIN l ON l.place_id IS NOT DISTINCT FROM c.place_id AND l.place_name = c.place_name
          AND l.continent IS NOT DISTINCT FROM c.continent AND l.place_country_code IS NOT DISTINCT FROM c.place_country_code""",
    ),
    "token_use": with_roles(
        both,
        SCORES + LABELLED + """SELECT place_id, CAST(SUM(100 + event_id % 17) AS BIGINT) AS prompt_tokens,
        CAST(SUM(10 + user_id % 5) AS BIGINT) AS completion_tokens FROM l GROUP BY 1""",
    ),
}
