"""Role views over the TPC-H-like test tables.

Each operator family reads a role with a fixed set of columns. These views
project the test tables onto the roles, row for row and without filters, so
that work grows with the tables. They use fixed dates and no clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_DATE = "2024-01-28"
ACTIVITY_AS_OF = "2001-07-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).selectExpr(
        "cast(c_custkey as string) AS user_id",
        f"date_sub(DATE'{RUN_DATE}', cast(CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END as int)) AS ds",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN '' ELSE n_name END AS country",
        """CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'en_US'
           WHEN c_custkey % 4 = 1 THEN 'EN_gb' WHEN c_custkey % 4 = 2 THEN 'fr_FR' ELSE 'de' END AS locale""",
        """CASE c_custkey % 6 WHEN 0 THEN '1 - None' WHEN 1 THEN '2 - Beginner' WHEN 2 THEN '3 - Elementary'
           WHEN 3 THEN '4 - Intermediate' WHEN 4 THEN '5 - Advanced' ELSE '6 - Expert' END AS creator_tier""",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal > 5000 END AS is_subscriber",
    )


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) AS user_id",
        f"DATE'{RUN_DATE}' AS ds",
        """CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 'x.1'
           WHEN c_custkey % 37 = 0 THEN '12'
           ELSE concat(c_custkey % 20, '.', c_custkey % 90, '.1') END AS version""",
        "CASE WHEN c_custkey % 2 = 0 THEN 'iOS' ELSE 'Android' END AS device_type",
        "cast(13 + c_custkey % 60 as int) AS age",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 3 <> 0 END AS is_email_verified",
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct order days of the last 7 and 90 days."""
    day = "to_date(o_orderdate)"
    recent = "CASE WHEN {d} BETWEEN date_sub(DATE'{a}', {n}) AND DATE'{a}' THEN {d} END"
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("user_id"))
        .agg(
            F.expr(f"count(DISTINCT {recent.format(d=day, a=ACTIVITY_AS_OF, n=6)})").alias("l_7"),
            F.expr(f"count(DISTINCT {recent.format(d=day, a=ACTIVITY_AS_OF, n=89)})").alias("l_90"),
        )
        .withColumn("ds", F.expr(f"DATE'{RUN_DATE}'"))
    )


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most users have one mapped id, some two, some none."""
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) AS internal_id",
        """explode(CASE WHEN c_custkey % 17 = 0 THEN cast(array() as array<string>)
           WHEN c_custkey % 19 = 0 THEN array(concat('m', c_custkey), concat('n', c_custkey))
           ELSE array(concat('m', c_custkey)) END) AS user_id""",
    )


def country_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name AS country",
        """CASE WHEN n_nationkey % 7 = 0 THEN '' WHEN n_nationkey % 7 = 1 THEN concat('Unknown ', n_name)
           ELSE n_name END AS name""",
    )


def email_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counter(kind: str, even: int) -> str:
        return (
            f"CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = '{kind}' "
            f"AND event_id % 2 = {even} THEN 1L ELSE 0L END"
        )

    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) AS user_id",
        "to_date(ts) AS ds",
        f"{counter('view', 0)} AS campaign_open",
        f"{counter('view', 1)} AS transactional_open",
        f"{counter('error', 0)} AS campaign_bounce",
        f"{counter('error', 1)} AS transactional_bounce",
        f"{counter('signup', 0)} AS campaign_unsubscribe",
        f"{counter('signup', 1)} AS transactional_unsubscribe",
    )


def email_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) AS user_id",
        "to_date(ts) AS ds",
        "CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 1L ELSE 0L END AS campaign_click",
        "CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN 1L ELSE 0L END AS transactional_click",
    )


def deep_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "cast(page_id % 150 as string) AS user_id",
        "date_add(DATE'2024-01-01', cast(page_id % 30 as int)) AS ds",
        "url AS deep_link_url",
        "CASE WHEN page_id % 2 = 1 THEN url END AS short_link_url",
    )


# Click rules that fit the page addresses of the test tables.
PAGE_CLICK_RULES = (
    ("deep_link_url", "page=", "Paged"),
    ("short_link_url", "/en/", "English"),
    ("deep_link_url", "#top", "Anchor"),
)


def region_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .selectExpr(
            "cast(c_custkey as string) AS user_id",
            f"DATE'{RUN_DATE}' AS ds",
            """CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN lower(r_name)
               ELSE r_name END AS region""",
        )
    )


def push_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("user_id"))
        .agg(
            F.count("*").alias("push_success_30d"),
            F.expr("sum(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1L END)").alias(
                "viewed_30d"
            ),
            F.expr("sum(CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 1L ELSE 0L END)").alias(
                "chat_viewed_30d"
            ),
        )
    )


def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("user_id"))
        .agg(F.expr("count(DISTINCT day(o_orderdate))").alias("active_days_l30"))
        .withColumn("ds", F.expr(f"DATE'{RUN_DATE}'"))
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an urgent order; one row per such order, so users repeat."""
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").selectExpr(
        "cast(o_custkey as string) AS user_id", f"DATE'{RUN_DATE}' AS ds"
    )


def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) AS user_id")


def campaign_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderdate AS ts",
        "to_date(o_orderdate) AS ds",
        """CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN (o_custkey % 97) % 2 = 0 THEN concat('C', o_custkey % 97)
           ELSE concat('c', o_custkey % 97, '-', year(o_orderdate)) END AS campaign_id""",
        """CASE o_orderkey % 3 WHEN 0 THEN 'FEED_HEADER_PROMPT' WHEN 1 THEN 'PROFILE_ACTIVITY_CARD'
 WHEN 2 THEN CASE WHEN o_orderkey % 43 <> 0 THEN 'FULL_SCREEN_TAKEOVER' END END AS surface""",
        "CASE o_orderstatus WHEN 'F' THEN 'IMPRESSION' WHEN 'O' THEN 'CLICK' ELSE 'DISMISS' END AS action",
        "cast(floor(o_totalprice) as bigint) AS action_cnt",
    )


def campaign_user_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per quarter: spread over users of campaigns seen and of impressions."""
    per_user = (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.expr("concat(year(o_orderdate), 'Q', quarter(o_orderdate))").alias("quarter"), "o_custkey"
        )
        .agg(
            F.expr("count(DISTINCT o_custkey % 97 + o_orderkey % 5)").alias("campaign"),
            F.count("*").alias("impression"),
        )
    )
    columns = []
    for name in ("campaign", "impression"):
        value = F.col(name).cast("double")
        columns += [
            F.min(value).alias(f"{name}_min"),
            F.percentile(value, 0.25).alias(f"{name}_p25"),
            F.percentile(value, 0.5).alias(f"{name}_median"),
            F.percentile(value, 0.75).alias(f"{name}_p75"),
            F.max(value).alias(f"{name}_max"),
        ]
    return per_user.groupBy("quarter").agg(*columns)


def campaign_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by how often they saw a campaign, with their clicks and dismissals."""
    per_user = (
        table(spark, sf_dir, "events")
        .groupBy(
            F.expr("concat(year(ts), 'Q', quarter(ts))").alias("quarter"),
            F.expr("concat('C', get_json_object(props, '$.k') % 10)").alias("campaign_id"),
            "user_id",
        )
        .agg(
            F.expr("count(CASE WHEN event_type = 'view' THEN 1 END)").alias("impression"),
            F.expr("count(CASE WHEN event_type = 'click' THEN 1 END)").alias("clicks"),
            F.expr("count(CASE WHEN event_type = 'error' THEN 1 END)").alias("dismissals"),
        )
    )
    return per_user.groupBy("quarter", "campaign_id", "impression").agg(
        F.count("*").alias("uu"),
        F.sum("clicks").alias("total_click"),
        F.sum("dismissals").alias("total_dismiss"),
    )


# Prediction in percent of the quantity: 70 to 130 by part, plus or minus 10 by discount.
PREDICTED_PERCENT = "(70 + (l_partkey % 7) * 10 + (round(l_discount * 100) - 5) * 2)"


def ad_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    # Amounts are whole numbers, so that sums are the same in any order.
    conv = "(CASE WHEN l_partkey % 50 = 0 THEN 0D ELSE l_quantity END)"
    pred = f"(l_quantity * {PREDICTED_PERCENT})"
    arm = "cast(conv(substr(md5(cast(l_orderkey as string)), 1, 8), 16, 10) as bigint) % 10"
    joined = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(
        customer, orders.o_custkey == customer.c_custkey
    )
    return joined.withColumn("_arm", F.expr(arm)).selectExpr(
        "concat('li', l_partkey) AS line_item_id",
        "concat('ac', o_custkey) AS ad_account_id",
        "CASE WHEN year(o_orderdate) % 2 = 0 THEN c_mktsegment ELSE 'GROWTH' END AS adv_size_by_revenue",
        "o_orderdate AS account_updated_at",
        """CASE WHEN l_linenumber = 7 THEN 'M7x0' WHEN l_linenumber % 2 = 0 THEN 'M_7_0'
           ELSE 'M_28_1' END AS model_type""",
        "CASE l_suppkey % 3 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'TARGET' ELSE 'MIN' END AS bid_strategy",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'APP_PURCHASE_VO' WHEN '2-HIGH' THEN 'APP_INSTALLS'
           WHEN '3-MEDIUM' THEN 'PIXEL_PURCHASE'
           WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PIXEL_PURCHASE_ROAS' ELSE 'APP_SIGNUP' END
           ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'IMPRESSIONS' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'SWIPES' END
           END AS optimization_goal""",
        "CASE WHEN _arm < 5 THEN 'BG_C' WHEN _arm < 9 THEN 'BG_T' ELSE 'BG_X' END AS bgid",
        "CASE WHEN _arm < 5 THEN 'BG_C' WHEN _arm < 9 THEN 'BG_T' ELSE 'BG_X' END AS winner_bgid",
        "to_date(l_shipdate) AS served_date",
        "cast(1 + l_linenumber as bigint) AS impressions",
        f"{conv} * 100 AS conversions_7_0",
        f"{conv} * 102 AS conversions_2_0",
        f"{conv} * 98 AS conversions_2_1",
        f"{conv} * 99 AS conversions_1_1",
        f"{conv} * 200 AS conversions_value_7_0",
        f"{conv} * 204 AS conversions_value_2_0",
        f"{conv} * 196 AS conversions_value_2_1",
        f"{conv} * 198 AS conversions_value_1_1",
        f"{pred} AS predicted_conversions",
        f"{pred} * 2 AS predicted_conversions_value",
        "cast(floor(l_extendedprice * (1 - l_discount)) as double) AS revenue",
        """CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN array(1, 2)
           WHEN 3 THEN cast(array() as array<int>) ELSE array(1, 3) END AS app_anomaly_severity""",
        "CASE WHEN l_suppkey % 17 = 0 THEN true WHEN l_suppkey % 19 = 0 THEN NULL ELSE false END AS is_house_ad",
        """CASE WHEN l_suppkey % 23 = 0 THEN true WHEN l_suppkey % 29 = 0 THEN NULL
           ELSE false END AS is_pixel_spammy""",
    )


def served_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per served item, with a simulation id. Amounts are multiples of 1/128: sums are exact."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('s', l_orderkey, '-', l_linenumber) END AS serve_item_id",
        "concat('li', l_partkey) AS line_item_id",
        """CASE l_returnflag WHEN 'A' THEN 'APP_INSTALLS' WHEN 'N' THEN 'PIXEL_PURCHASE'
           ELSE 'APP_PURCHASE' END AS optimization_goal""",
        "CASE WHEN l_partkey % 50 = 0 THEN 0D ELSE l_quantity * 100 / 128D END AS conversions",
        f"l_quantity * {PREDICTED_PERCENT} / 128D AS predicted_conversions",
        "cast(floor(l_extendedprice * (1 - l_discount)) as double) AS revenue",
        "CASE WHEN l_orderkey % 101 <> 0 THEN cast(l_orderkey % 50 as int) END AS sim_id",
    )


def aa_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per iteration and line item: both arms of an A/A split, side by side."""
    rows = served_items(spark, sf_dir).withColumn(
        "arm", F.expr("CASE WHEN right(md5(line_item_id || coalesce(serve_item_id, '')), 1) < '8' THEN 1 ELSE 2 END")
    )

    def total(column: str, arm: int):
        value = F.when(F.col("arm") == arm, F.col(column)).otherwise(F.lit(0))
        return F.sum(value)

    return rows.groupBy(F.col("sim_id").alias("iteration_id"), "line_item_id").agg(
        *[
            total(column, arm).alias(f"{short}_a{arm}")
            for short, column in (
                ("conv", "conversions"), ("pred_conv", "predicted_conversions"), ("rev", "revenue"),
            )
            for arm in (1, 2)
        ]
    )


def experiment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations before steps are numbered: experiment, arm, order columns, value."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS experiment_id",
        "CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm",
        "ts",
        "event_id",
        "10 * sqrt(value) + CASE WHEN user_id % 2 = 1 AND event_type IN ('purchase', 'click') THEN 15 ELSE 0 END AS x",
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') as int)"
    return table(spark, sf_dir, "events").selectExpr(
        f"CASE {k} % 3 WHEN 0 THEN 'Europe' WHEN 1 THEN 'America' ELSE 'Asia' END AS continent",
        f"CASE {k} % 4 WHEN 0 THEN 'Elsewhere' ELSE 'North America' END AS inclusive_region",
        f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE concat('K', {k} % 9) END AS place_country_code",
        f"CASE WHEN event_id % 89 <> 0 THEN concat('p', {k}) END AS place_id",
        f"CASE WHEN event_id % 97 = 0 THEN concat('Old Place ', {k}) ELSE concat('Place ', {k}) END AS place_name",
        f"concat('R', {k} % 8) AS place_region",
        f"concat('Country ', {k} % 9) AS place_country",
        "concat('s', event_id) AS story_id",
        "concat('link/', event_id) AS story_link",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('venue ', user_id) END AS venue_name",
        "ts AS event_time",
        "to_date(ts) AS ds",
        "value AS time_viewed_total_day",
        "CASE WHEN event_id % 53 = 0 THEN NULL ELSE cast(floor(value * 10) as bigint) END AS views_total_day",
    )


def story_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media addresses; every fifth story has a second row."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "to_date(ts) AS ds",
        "explode(CASE WHEN event_id % 5 = 0 THEN array(0, 1) ELSE array(0) END) AS copy",
    ).selectExpr(
        "concat('s', event_id) AS story_id",
        "cast(1704067200000 + (event_id % 5000) * 60000 + copy * 1000 as string) AS submit_ts",
        "CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL ELSE concat('flat/', event_id) END AS flat_url",
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 44 = 4 THEN '' ELSE concat('media/', event_id, '-', copy) END AS media_url",
        "ds",
    )


def story_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label text per story, with the token use of the call that made it."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('s', event_id) AS story_id",
        """concat('{\\'short_description\\': \\'Story ', event_id, '\\', \\'long_description\\': \\'Seen by ', user_id,
           '\\', \\'keywords\\': [\\'', event_type, ' wave\\', \\'user ', user_id % 7, '\\'], \\'event_type\\': \\'', event_type,
           '\\', \\'event_scale\\': ', CASE WHEN user_id % 3 = 0 THEN 'None' ELSE concat('\\'scale ', user_id % 3, '\\'') END,
           ', \\'event_duration\\': \\'d', event_id % 4, '\\', \\'event_intensity\\': \\'i', event_id % 3,
           '\\', \\'associated_mood\\': \\'m', user_id % 5, '\\', \\'key_objects\\': [\\'obj ', user_id % 4,
           '\\'], \\'activity_type\\': [\\'act ', event_id % 6, '\\'], \\'contributing_context\\': [], ',
           '\\'virality_potential\\': 0.', event_id % 10, '}') AS labels""",
        "cast(100 + event_id % 17 as bigint) AS prompt_tokens",
        "cast(10 + user_id % 5 as bigint) AS completion_tokens",
    )


def story_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content type of each story's file."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('s', event_id) AS story_id",
        """CASE event_id % 6 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png'
           WHEN 3 THEN 'text/html' WHEN 4 THEN 'image/webp' END AS content_type""",
    )


def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label text per place; every fourth is cut off."""
    places = table(spark, sf_dir, "events").selectExpr("cast(get_json_object(props, '$.k') as int) AS k").distinct()
    return places.selectExpr(
        "concat('p', k) AS place_id",
        """concat('{\\'short_description\\': \\'About ', k, '\\', \\'long_description\\': \\'All of ', k,
           '\\', \\'keywords\\': (\\'word ', k % 7, '\\', \\'more\\'), \\'key_objects\\': [\\'thing ', k % 3, '\\']',
           CASE WHEN k % 4 = 0 THEN '' ELSE '}' END) AS labels""",
    )


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label texts written from known columns: good, truncated, with Timestamp('...'), with bare tokens."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        """CASE
             WHEN p_partkey % 5 = 1 THEN concat('{\\'short description\\': \\'', p_name, '\\', \\'event_type\\': ', p_type,
               ', \\'place_id\\': \\'pl', p_size, '\\', \\'virality_potential\\': \\'0.', p_size,
               '\\', \\'keywords\\': [\\'', p_name, '\\', \\'', p_brand, '\\'')
             WHEN p_partkey % 5 = 2 THEN concat('{\\'short_description\\': \\'', p_name, '\\', \\'event_type\\': \\'', p_type,
               '\\', \\'detection_start_time\\': Timestamp(\\'2024-01-', lpad(cast(1 + p_size % 28 as string), 2, '0'),
               ' 00:00:00\\'), \\'place_id\\': \\'pl', p_size, '\\', \\'viralityPotential\\': 0.', p_size,
               ', \\'keywords\\': [\\'', p_name, '\\', \\'', p_brand, '\\']}')
             WHEN p_partkey % 5 = 3 THEN concat('{\\'short_description\\': \\'', p_name, '\\', \\'event_type\\': \\'', p_type,
               '\\', \\'event_scale\\': None, \\'place_id\\': \\'pl', p_size, '\\', \\'viral_potential\\': \\'~0.', p_size,
               '\\', \\'keywords\\': \\'', p_name, ', ', p_brand, '\\'}')
             WHEN p_partkey % 55 = 0 THEN ''
             WHEN p_partkey % 65 = 0 THEN NULL
             WHEN p_partkey % 85 = 0 THEN p_name
             ELSE concat('{\\'short_description\\': \\'', p_name, '\\', \\'event_type\\': \\'', p_type,
               '\\', \\'detection_start_time\\': \\'2024-01-', lpad(cast(1 + p_size % 28 as string), 2, '0'),
               ' 00:00:00\\', \\'place_id\\': \\'pl', p_size, '\\', \\'virality_potential\\': 0.', p_size,
               ', \\'keywords\\': [\\'', p_name, '\\', \\'', p_brand, '\\']}')
           END AS labels""",
    )
