"""The role views as DuckDB common table expressions."""

RUN_DATE = "2024-01-28"
ACTIVITY_AS_OF = "2001-07-30"

ROLES = {
    "cohort": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS user_id,
          DATE '{RUN_DATE}' - CAST(CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END AS INTEGER) AS ds,
          CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN '' ELSE n_name END AS country,
          CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'en_US'
            WHEN c_custkey % 4 = 1 THEN 'EN_gb' WHEN c_custkey % 4 = 2 THEN 'fr_FR' ELSE 'de' END AS locale,
          CASE c_custkey % 6 WHEN 0 THEN '1 - None' WHEN 1 THEN '2 - Beginner' WHEN 2 THEN '3 - Elementary'
            WHEN 3 THEN '4 - Intermediate' WHEN 4 THEN '5 - Advanced' ELSE '6 - Expert' END AS creator_tier,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal > 5000 END AS is_subscriber
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "identity": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, DATE '{RUN_DATE}' AS ds,
          CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 'x.1'
            WHEN c_custkey % 37 = 0 THEN '12'
            ELSE concat(c_custkey % 20, '.', c_custkey % 90, '.1') END AS version,
          CASE WHEN c_custkey % 2 = 0 THEN 'iOS' ELSE 'Android' END AS device_type,
          CAST(13 + c_custkey % 60 AS INTEGER) AS age,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 3 <> 0 END AS is_email_verified
        FROM customer""",
    "activity": f"""
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, DATE '{RUN_DATE}' AS ds,
          COUNT(DISTINCT CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '{ACTIVITY_AS_OF}' - 6
            AND DATE '{ACTIVITY_AS_OF}' THEN CAST(o_orderdate AS DATE) END) AS l_7,
          COUNT(DISTINCT CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '{ACTIVITY_AS_OF}' - 89
            AND DATE '{ACTIVITY_AS_OF}' THEN CAST(o_orderdate AS DATE) END) AS l_90
        FROM orders GROUP BY 1, 2""",
    "id_map": """
        SELECT CAST(c_custkey AS VARCHAR) AS internal_id, unnest(CASE WHEN c_custkey % 17 = 0 THEN []
          WHEN c_custkey % 19 = 0 THEN ['m' || c_custkey, 'n' || c_custkey]
          ELSE ['m' || c_custkey] END) AS user_id
        FROM customer""",
    "country_map": """
        SELECT n_name AS country, CASE WHEN n_nationkey % 7 = 0 THEN ''
          WHEN n_nationkey % 7 = 1 THEN 'Unknown ' || n_name ELSE n_name END AS name
        FROM nation""",
    "email_touch": """
        SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS ds,
          CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'view' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS campaign_open,
          CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'view' AND event_id % 2 = 1 THEN 1 ELSE 0 END AS transactional_open,
          CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS campaign_bounce,
          CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' AND event_id % 2 = 1 THEN 1 ELSE 0 END AS transactional_bounce,
          CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS campaign_unsubscribe,
          CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'signup' AND event_id % 2 = 1 THEN 1 ELSE 0 END AS transactional_unsubscribe
        FROM events""",
    "email_click": """
        SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS ds,
          CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS campaign_click,
          CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN 1 ELSE 0 END AS transactional_click
        FROM events""",
    "deep_link": """
        SELECT CAST(page_id % 150 AS VARCHAR) AS user_id, DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS ds,
          url AS deep_link_url, CASE WHEN page_id % 2 = 1 THEN url END AS short_link_url
        FROM pages""",
    "region_dim": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, DATE '{RUN_DATE}' AS ds,
          CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN lower(r_name) ELSE r_name END AS region
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "push_lookback": """
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, COUNT(*) AS push_success_30d,
          SUM(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 END) AS viewed_30d,
          SUM(CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 1 ELSE 0 END) AS chat_viewed_30d
        FROM orders GROUP BY 1""",
    "feature_usage": f"""
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, DATE '{RUN_DATE}' AS ds,
          COUNT(DISTINCT day(o_orderdate)) AS active_days_l30
        FROM orders GROUP BY 1, 2""",
    "members": f"""
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, DATE '{RUN_DATE}' AS ds
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "exclusion": "SELECT CAST(s_suppkey AS VARCHAR) AS user_id FROM supplier",
    "campaign_daily": """
        SELECT o_orderdate AS ts, CAST(o_orderdate AS DATE) AS ds,
          CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN (o_custkey % 97) % 2 = 0 THEN 'C' || (o_custkey % 97)
            ELSE 'c' || (o_custkey % 97) || '-' || year(o_orderdate) END AS campaign_id,
          CASE o_orderkey % 3 WHEN 0 THEN 'FEED_HEADER_PROMPT' WHEN 1 THEN 'PROFILE_ACTIVITY_CARD'
            WHEN 2 THEN CASE WHEN o_orderkey % 43 <> 0 THEN 'FULL_SCREEN_TAKEOVER' END END AS surface,
          CASE o_orderstatus WHEN 'F' THEN 'IMPRESSION' WHEN 'O' THEN 'CLICK' ELSE 'DISMISS' END AS action,
          CAST(floor(o_totalprice) AS BIGINT) AS action_cnt,
          year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
          strftime(o_orderdate, '%Y-%m') AS month
        FROM orders""",
    "user_counts": """
        SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_custkey,
          CAST(COUNT(DISTINCT o_custkey % 97 + o_orderkey % 5) AS DOUBLE) AS campaign, CAST(COUNT(*) AS DOUBLE) AS impression
        FROM orders GROUP BY ALL""",
    "campaign_frequency": """
        SELECT quarter, campaign_id, impression, COUNT(*) AS uu, SUM(clicks) AS total_click, SUM(dismissals) AS total_dismiss
        FROM (
          SELECT year(ts) || 'Q' || quarter(ts) AS quarter, 'C' || (CAST(props->>'$.k' AS INTEGER) % 10) AS campaign_id,
            user_id, COUNT(CASE WHEN event_type = 'view' THEN 1 END) AS impression,
            COUNT(CASE WHEN event_type = 'click' THEN 1 END) AS clicks,
            COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS dismissals
          FROM events GROUP BY 1, 2, 3)
        GROUP BY 1, 2, 3""",
    "ad_facts": """
        SELECT 'li' || l_partkey AS line_item_id, 'ac' || o_custkey AS ad_account_id,
          CASE WHEN year(o_orderdate) % 2 = 0 THEN c_mktsegment ELSE 'GROWTH' END AS adv_size_by_revenue,
          o_orderdate AS account_updated_at,
          CASE WHEN l_linenumber = 7 THEN 'M7x0' WHEN l_linenumber % 2 = 0 THEN 'M_7_0' ELSE 'M_28_1' END AS model_type,
          CASE l_suppkey % 3 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'TARGET' ELSE 'MIN' END AS bid_strategy,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'APP_PURCHASE_VO' WHEN '2-HIGH' THEN 'APP_INSTALLS'
            WHEN '3-MEDIUM' THEN 'PIXEL_PURCHASE'
            WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PIXEL_PURCHASE_ROAS' ELSE 'APP_SIGNUP' END
            ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'IMPRESSIONS' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'SWIPES' END
            END AS optimization_goal,
          CASE WHEN h < 5 THEN 'BG_C' WHEN h < 9 THEN 'BG_T' ELSE 'BG_X' END AS bgid,
          CASE WHEN h < 5 THEN 'BG_C' WHEN h < 9 THEN 'BG_T' ELSE 'BG_X' END AS winner_bgid,
          CAST(l_shipdate AS DATE) AS served_date, CAST(1 + l_linenumber AS BIGINT) AS impressions,
          c0 * 100 AS conversions_7_0, c0 * 102 AS conversions_2_0, c0 * 98 AS conversions_2_1, c0 * 99 AS conversions_1_1,
          c0 * 200 AS conversions_value_7_0, c0 * 204 AS conversions_value_2_0, c0 * 196 AS conversions_value_2_1,
          c0 * 198 AS conversions_value_1_1, p0 AS predicted_conversions, p0 * 2 AS predicted_conversions_value,
          floor(l_extendedprice * (1 - l_discount)) AS revenue,
          CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN [1, 2] WHEN 3 THEN [] ELSE [1, 3] END AS app_anomaly_severity,
          CASE WHEN l_suppkey % 17 = 0 THEN true WHEN l_suppkey % 19 = 0 THEN NULL ELSE false END AS is_house_ad,
          CASE WHEN l_suppkey % 23 = 0 THEN true WHEN l_suppkey % 29 = 0 THEN NULL ELSE false END AS is_pixel_spammy
        FROM (
          SELECT *, CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE l_quantity END AS c0,
            l_quantity * (70 + (l_partkey % 7) * 10 + (round(l_discount * 100) - 5) * 2) AS p0,
            CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS h
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)""",
    "served_items": """
        SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('s', l_orderkey, '-', l_linenumber) END AS serve_item_id,
          'li' || l_partkey AS line_item_id,
          CASE l_returnflag WHEN 'A' THEN 'APP_INSTALLS' WHEN 'N' THEN 'PIXEL_PURCHASE' ELSE 'APP_PURCHASE' END AS optimization_goal,
          CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE l_quantity * 100 / 128.0::DOUBLE END AS conversions,
          l_quantity * (70 + (l_partkey % 7) * 10 + (round(l_discount * 100) - 5) * 2) / 128.0::DOUBLE AS predicted_conversions,
          floor(l_extendedprice * (1 - l_discount)) AS revenue,
          CASE WHEN l_orderkey % 101 <> 0 THEN CAST(l_orderkey % 50 AS INTEGER) END AS sim_id
        FROM lineitem""",
    "aa_wide": """
        SELECT sim_id AS iteration_id, line_item_id,
          CAST(SUM(CASE WHEN arm = 1 THEN conversions ELSE 0 END) AS DOUBLE) AS conv_a1,
          CAST(SUM(CASE WHEN arm = 2 THEN conversions ELSE 0 END) AS DOUBLE) AS conv_a2,
          CAST(SUM(CASE WHEN arm = 1 THEN predicted_conversions ELSE 0 END) AS DOUBLE) AS pred_conv_a1,
          CAST(SUM(CASE WHEN arm = 2 THEN predicted_conversions ELSE 0 END) AS DOUBLE) AS pred_conv_a2,
          CAST(SUM(CASE WHEN arm = 1 THEN revenue ELSE 0 END) AS DOUBLE) AS rev_a1,
          CAST(SUM(CASE WHEN arm = 2 THEN revenue ELSE 0 END) AS DOUBLE) AS rev_a2
        FROM (SELECT *, CASE WHEN right(md5(line_item_id || coalesce(serve_item_id, '')), 1) < '8' THEN 1 ELSE 2 END AS arm
              FROM served_items)
        GROUP BY 1, 2""",
    "experiment_obs": """
        SELECT experiment_id, arm, row_number() OVER (PARTITION BY experiment_id, arm ORDER BY ts, event_id) AS step, x
        FROM (SELECT event_type AS experiment_id, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm,
                ts, event_id,
                10 * sqrt(value) + CASE WHEN user_id % 2 = 1 AND event_type IN ('purchase', 'click') THEN 15 ELSE 0 END AS x
              FROM events)""",
    "stories": """
        SELECT CASE k % 3 WHEN 0 THEN 'Europe' WHEN 1 THEN 'America' ELSE 'Asia' END AS continent,
          CASE k % 4 WHEN 0 THEN 'Elsewhere' ELSE 'North America' END AS inclusive_region,
          CASE WHEN k % 5 = 0 THEN NULL ELSE 'K' || (k % 9) END AS place_country_code,
          CASE WHEN event_id % 89 <> 0 THEN 'p' || k END AS place_id,
          CASE WHEN event_id % 97 = 0 THEN 'Old Place ' || k ELSE 'Place ' || k END AS place_name,
          'R' || (k % 8) AS place_region, 'Country ' || (k % 9) AS place_country,
          's' || event_id AS story_id, 'link/' || event_id AS story_link,
          CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'venue ' || user_id END AS venue_name,
          ts AS event_time, CAST(ts AS DATE) AS ds, value AS time_viewed_total_day,
          CASE WHEN event_id % 53 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS views_total_day
        FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)""",
    "story_media": """
        SELECT 's' || event_id AS story_id,
          CAST(1704067200000 + (event_id % 5000) * 60000 + copy * 1000 AS VARCHAR) AS submit_ts,
          CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL ELSE 'flat/' || event_id END AS flat_url,
          CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 44 = 4 THEN '' ELSE concat('media/', event_id, '-', copy) END AS media_url,
          ds
        FROM (SELECT event_id, CAST(ts AS DATE) AS ds, unnest(CASE WHEN event_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM events)""",
}

# Roles that read other roles.
NEEDS = {"aa_wide": ["served_items"]}


def with_roles(roles: list[str], body: str) -> str:
    """Put the roles in front of a query that starts with a WITH-less body or further CTEs."""
    ordered = []
    for role in roles:
        for name in [*NEEDS.get(role, []), role]:
            if name not in ordered:
                ordered.append(name)
    ctes = ", ".join(f"{name} AS ({ROLES[name]})" for name in ordered)
    return f"WITH {ctes} {body}"
