"""SQL of the audience queries."""

from oracle.roles import RUN_DATE, with_roles

TODAY = f"DATE '{RUN_DATE}'"
COUNTRIES = "NATION_10,NATION_12,NATION_3,NATION_21,NATION_17,NATION_5"
FULL_COUNTRIES = ",".join(f"NATION_{n}" for n in range(1, 25) if n not in (7, 9, 13))
VERSION = (
    "(TRY_CAST(split_part(i.version, '.', 1) AS INTEGER) * 100 "
    "+ TRY_CAST(NULLIF(split_part(i.version, '.', 2), '') AS INTEGER)) / 100.0"
)
OPENED = "(coalesce(t.campaign_open, 0) > 0 OR coalesce(t.transactional_open, 0) > 0)"
BOUNCED = (
    "(coalesce(t.campaign_bounce, 0) > 0 OR coalesce(t.campaign_unsubscribe, 0) > 0 "
    "OR coalesce(t.transactional_bounce, 0) > 0 OR coalesce(t.transactional_unsubscribe, 0) > 0)"
)
CLICKS = """
    SELECT user_id, ds FROM email_click WHERE campaign_click > 0 OR transactional_click > 0
    UNION ALL
    SELECT user_id, ds FROM deep_link WHERE lower(deep_link_url) LIKE '%page=%'
      OR lower(short_link_url) LIKE '%/en/%' OR lower(deep_link_url) LIKE '%#top%'"""
MAPPED = "SELECT DISTINCT m.user_id FROM cohort c JOIN id_map m ON m.internal_id = c.user_id"
HERE = f"WHERE c.ds = {TODAY}"
EMAIL = f"""SELECT DISTINCT c.user_id FROM cohort c JOIN identity i ON i.user_id = c.user_id
    AND i.ds = {TODAY} AND i.is_email_verified"""
HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % 10 < 5"

SQL = {
    "audience_filters": with_roles(
        ["cohort", "identity", "activity", "region_dim", "id_map"],
        f"""{MAPPED} JOIN identity i ON i.user_id = c.user_id AND i.ds = {TODAY}
        JOIN activity a ON a.user_id = c.user_id AND a.ds = {TODAY}
        LEFT JOIN region_dim r ON r.user_id = c.user_id AND r.ds = {TODAY}
        {HERE} AND left(upper(c.locale), 2) = 'EN' AND a.l_90 >= 1 AND {VERSION} >= 5.1
        AND upper(i.device_type) = 'IOS' AND i.age BETWEEN 15 AND 60
        AND c.creator_tier IN ('3 - Elementary', '4 - Intermediate', '5 - Advanced', '6 - Expert')
        AND c.is_subscriber = false AND '{FULL_COUNTRIES}' LIKE concat('%', CASE WHEN c.country IS NOT NULL THEN c.country END, '%')
        AND c.country IS NOT NULL
        AND upper('Africa,ASIA,europe') LIKE upper('%' || r.region || '%')""",
    ),
    "audience_not_english": with_roles(
        ["cohort", "id_map"],
        f"""{MAPPED} {HERE} AND left(upper(c.locale), 2) <> 'EN' AND c.creator_tier = '2 - Beginner'
        AND c.is_subscriber""",
    ),
    "audience_activity": with_roles(
        ["cohort", "activity", "id_map"],
        f"{MAPPED} JOIN activity a ON a.user_id = c.user_id {HERE} AND a.l_7 < 2 AND a.l_90 > 0",
    ),
    "audience_country_in": with_roles(
        ["cohort", "country_map", "id_map"],
        f"""{MAPPED} {HERE} AND c.country IN (SELECT country FROM country_map WHERE name <> ''
        AND upper(name) NOT LIKE 'UNKNOWN%')""",
    ),
    "audience_country_list": with_roles(
        ["cohort", "identity"], f"{EMAIL} {HERE} AND c.country IN ('NATION_3', 'NATION_8', 'NATION_12')"
    ),
    "audience_locale_prefix": with_roles(
        ["cohort", "id_map"], f"{MAPPED} {HERE} AND upper(c.locale) LIKE 'FR%'"
    ),
    "audience_email_verified_split": with_roles(
        ["cohort", "identity"],
        f"""SELECT user_id, CASE WHEN {HASH.format('user_id')} THEN 'treatment' ELSE 'control' END AS group_assignment
        FROM ({EMAIL} {HERE})""",
    ),
    "audience_opened_window": with_roles(
        ["cohort", "identity", "email_touch"],
        f"""{EMAIL} JOIN email_touch t ON t.user_id = c.user_id
        AND t.ds BETWEEN {TODAY} - 3 AND {TODAY} - 1 AND {OPENED} {HERE}""",
    ),
    "audience_not_bounced": with_roles(
        ["cohort", "identity", "email_touch"],
        f"""{EMAIL} LEFT JOIN email_touch t ON t.user_id = c.user_id
        AND t.ds BETWEEN {TODAY} - 1 AND {TODAY} AND {BOUNCED} {HERE} AND t.user_id IS NULL""",
    ),
    "audience_members": with_roles(
        ["cohort", "members", "id_map"],
        f"{MAPPED} LEFT JOIN members g ON g.user_id = c.user_id {HERE} AND g.user_id IS NOT NULL",
    ),
    "audience_non_members": with_roles(
        ["cohort", "members", "id_map"],
        f"{MAPPED} LEFT JOIN members g ON g.user_id = c.user_id {HERE} AND g.user_id IS NULL",
    ),
    "audience_excluded": with_roles(
        ["cohort", "exclusion", "id_map"],
        f"{MAPPED} LEFT JOIN exclusion x ON x.user_id = c.user_id {HERE} AND x.user_id IS NULL",
    ),
    "audience_usage_min": with_roles(
        ["cohort", "feature_usage", "id_map"],
        f"""{MAPPED} LEFT JOIN feature_usage u ON u.user_id = c.user_id AND u.active_days_l30 >= 8
        {HERE} AND u.user_id IS NOT NULL""",
    ),
    "audience_pushed_not_viewed": with_roles(
        ["cohort", "push_lookback", "id_map"],
        f"""{MAPPED} LEFT JOIN push_lookback b ON b.user_id = c.user_id AND b.push_success_30d >= 5
        AND coalesce(b.viewed_30d, 0) = 0 AND coalesce(b.chat_viewed_30d, 0) = 0 {HERE} AND b.user_id IS NULL""",
    ),
    "audience_full": with_roles(
        ["cohort", "identity", "activity", "region_dim", "email_touch", "email_click", "deep_link",
         "push_lookback", "feature_usage"],
        f"""SELECT user_id, CASE WHEN {HASH.format('user_id')} THEN 'treatment' ELSE 'control' END AS group_assignment FROM ({EMAIL}
        JOIN activity a ON a.user_id = c.user_id
        LEFT JOIN region_dim r ON r.user_id = c.user_id
        JOIN (SELECT DISTINCT user_id FROM email_touch t WHERE ds BETWEEN {TODAY} - 20 AND {TODAY} AND {OPENED}) o
          ON o.user_id = c.user_id
        JOIN (SELECT DISTINCT user_id FROM ({CLICKS}) WHERE ds BETWEEN {TODAY} - 27 AND {TODAY}) k
          ON k.user_id = c.user_id
        LEFT JOIN (SELECT DISTINCT user_id FROM email_touch t WHERE ds BETWEEN {TODAY} - 1 AND {TODAY} AND {BOUNCED}) b
          ON b.user_id = c.user_id
        LEFT JOIN push_lookback q ON q.user_id = c.user_id AND q.push_success_30d >= 5
          AND coalesce(q.viewed_30d, 0) = 0 AND coalesce(q.chat_viewed_30d, 0) = 0
        LEFT JOIN feature_usage u ON u.user_id = c.user_id AND u.active_days_l30 >= 2
        {HERE} AND left(upper(c.locale), 2) = 'EN' AND a.l_90 >= 0 AND {VERSION} >= 1.0 AND i.age BETWEEN 13 AND 70
        AND c.creator_tier IN ('2 - Beginner', '3 - Elementary', '4 - Intermediate', '5 - Advanced', '6 - Expert')
        AND '{FULL_COUNTRIES}' LIKE '%' || c.country || '%'
        AND upper('AFRICA,AMERICA,ASIA,EUROPE') LIKE upper('%' || r.region || '%')
        AND b.user_id IS NULL AND q.user_id IS NULL AND u.user_id IS NOT NULL)""",
    ),
    "audience_clicked_union": with_roles(
        ["cohort", "email_click", "deep_link"],
        f"""SELECT DISTINCT c.user_id FROM cohort c JOIN ({CLICKS}) k ON k.user_id = c.user_id
        AND k.ds BETWEEN {TODAY} - 2 AND {TODAY}""",
    ),
    "audience_link_labels": with_roles(
        ["deep_link"],
        """SELECT label, strftime(ds, '%y%m%d') AS day_code, COUNT(*) AS visits FROM (
          SELECT DISTINCT user_id, ds, CASE WHEN lower(deep_link_url) LIKE '%page=%' THEN 'Paged'
            WHEN lower(short_link_url) LIKE '%/en/%' THEN 'English' WHEN lower(deep_link_url) LIKE '%#top%' THEN 'Anchor' END AS label
          FROM deep_link) WHERE label IS NOT NULL GROUP BY 1, 2""",
    ),
    "audience_bounced_two_years": with_roles(
        ["email_touch"],
        f"""SELECT DISTINCT user_id FROM email_touch t
        WHERE ds BETWEEN {TODAY} + 2 - INTERVAL 2 YEAR AND {TODAY} AND {BOUNCED}""",
    ),
    "audience_region_attribute": with_roles(
        ["cohort", "region_dim"],
        f"""SELECT r.region, COUNT(*) AS users FROM cohort c LEFT JOIN region_dim r ON r.user_id = c.user_id
        AND r.ds = {TODAY} {HERE} GROUP BY 1""",
    ),
    "audience_country_match": with_roles(
        ["cohort"],
        f"""SELECT country, COUNT(*) FILTER ('{COUNTRIES}' LIKE '%' || country || '%') AS by_text,
        COUNT(*) FILTER (list_contains(string_split('{COUNTRIES}', ','), country)) AS by_code
        FROM cohort c {HERE} GROUP BY 1""",
    ),
}
SQL["audience_count"] = f"SELECT COUNT(*) AS total_rows FROM ({SQL['audience_filters']})"
SQL["audience_view"] = with_roles(
    ["cohort", "identity"], f"{EMAIL} {HERE} AND left(upper(c.locale), 2) = 'EN'"
)
SQL["audience_view_all_days"] = with_roles(
    ["cohort", "identity"],
    f"""SELECT DISTINCT c.user_id FROM cohort c JOIN identity i ON i.user_id = c.user_id AND i.is_email_verified
    WHERE c.ds BETWEEN {TODAY} - 1 AND {TODAY} AND left(upper(c.locale), 2) = 'EN' AND {HASH.format('c.user_id')}""",
)
SQL["audience_full_stored"] = SQL["audience_full"]
SQL["audience_run_date_view"] = SQL["audience_view"]
SQL["audience_replaced"] = with_roles(
    ["cohort", "id_map"],
    f"""SELECT 'failed' AS step, user_id FROM ({MAPPED} {HERE} AND left(upper(c.locale), 2) <> 'EN'
      AND c.creator_tier = '2 - Beginner' AND c.is_subscriber)
    UNION ALL SELECT 'replaced', user_id FROM ({MAPPED} {HERE} AND upper(c.locale) LIKE 'FR%')""",
)
