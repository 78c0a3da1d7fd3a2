"""SQL of the campaign queries."""

from oracle.roles import with_roles

START, END, NOW = "1998-03-31", "2000-03-31", "2000Q1"
QUARTERS = [f"{y}Q{q}" for y in (1998, 1999) for q in (1, 2, 3, 4)] + ["2000Q1"]
SURFACES = ["FEED_HEADER_PROMPT", "PROFILE_ACTIVITY_CARD", "FULL_SCREEN_TAKEOVER"]
ROWS = f""", r AS (SELECT * FROM campaign_daily WHERE ds BETWEEN DATE '{START}' AND DATE '{END}' AND campaign_id <> ''
    AND action IN ('IMPRESSION', 'CLICK', 'DISMISS'))"""


def even(text: str, digits: int) -> str:
    return f"(round_even(CAST({text} AS DOUBLE), {digits}) + 0.0::DOUBLE)"


def change(value: str, period: str) -> str:
    before = f"lag({value}) OVER (ORDER BY {period})"
    return even(f"(CAST({value} AS DOUBLE) / nullif({before}, 0) - 1) * 100", 2)


def q(body: str, roles=("campaign_daily",)) -> str:
    return with_roles(list(roles), ROWS + body)


SURFACE = """SELECT *, {dist} AS impression_distribution, {bn} AS impression_billionth FROM (
    SELECT *, CAST(SUM(surface_impression_count) OVER (PARTITION BY quarter) AS BIGINT) AS impression_count FROM (
      SELECT quarter, surface, COUNT(DISTINCT campaign_id) AS surface_campaign_count,
        CAST(SUM(action_cnt) FILTER (action = 'IMPRESSION') AS BIGINT) AS surface_impression_count FROM r GROUP BY 1, 2))
    WHERE surface_impression_count IS NOT NULL AND surface IS NOT NULL""".format(
    dist=even("CAST(surface_impression_count AS DOUBLE) / impression_count * 100", 2),
    bn=even("surface_impression_count / 1e9", 2),
)


def counts(keys: str, prefix: str, where: str = "true") -> str:
    three = ", ".join(
        f"CAST(coalesce(SUM(action_cnt) FILTER (action = '{a}'), 0) AS BIGINT) AS {a}" for a in ("IMPRESSION", "CLICK", "DISMISS")
    )
    return f"""SELECT *, {even('CAST(CLICK AS DOUBLE) / nullif(IMPRESSION, 0)', 4)} AS {prefix}_ctr,
      {even('CAST(DISMISS AS DOUBLE) / nullif(IMPRESSION, 0)', 4)} AS {prefix}_dismiss_rate
      FROM (SELECT {keys}, {three} FROM r WHERE {where} AND surface IS NOT NULL GROUP BY ALL)"""


RATES = f"""SELECT c.*, o.overall_ctr, o.overall_dismiss_rate
    FROM ({counts('surface, campaign_id', 'campaign', f"quarter = '{NOW}'")}) c
    JOIN ({counts('surface', 'overall', f"quarter = '{NOW}'")}) o ON o.surface = c.surface"""

QUARTER_SUMS = ", ".join(
    f"""CAST(coalesce(SUM(action_cnt) FILTER (quarter = '{x}'), 0) AS BIGINT) AS "{x}" """ for x in QUARTERS
)
QUARTER_CHANGES = ", ".join(
    "coalesce(" + even(f'(CAST("{b}" AS DOUBLE) / nullif("{a}", 0) - 1) * 100', 2) + f', 0) AS "{b}_qoq_change"'
    for a, b in zip(QUARTERS, QUARTERS[1:])
)


def distribution(name: str) -> str:
    lines = []
    for stat, value in (("min", f"min({name})"), ("p25", f"quantile_cont({name}, 0.25)"),
                        ("median", f"quantile_cont({name}, 0.5)"), ("p75", f"quantile_cont({name}, 0.75)")):
        columns = ", ".join(
            f"""round({value} FILTER (quarter = '{x}'), 6) AS "{x}" """ for x in QUARTERS
        )
        lines.append(f"SELECT '{name}' AS measure, '{stat}' AS stat, {columns} FROM user_counts")
    return " UNION ALL ".join(lines)


SQL = {
    "campaign_summary": q(f"""SELECT quarter, campaign_count, coalesce({change('campaign_count', 'quarter')}, 0) AS campaign_count_qoq,
        impression_count, coalesce({change('impression_count', 'quarter')}, 0) AS impression_count_qoq FROM (
          SELECT quarter, COUNT(DISTINCT campaign_id) AS campaign_count,
            CAST(SUM(action_cnt) FILTER (action = 'IMPRESSION') AS BIGINT) AS impression_count FROM r GROUP BY 1)
        WHERE impression_count IS NOT NULL"""),
    "campaign_monthly": q(f"""SELECT month, impression_count, {change('impression_count', 'month')} AS impression_count_mom FROM (
        SELECT month, CAST(SUM(action_cnt) AS BIGINT) AS impression_count FROM r WHERE action = 'IMPRESSION' GROUP BY 1)"""),
    "surface_share": q(SURFACE),
    "surface_pivot": q("SELECT quarter, " + ", ".join(
        f"CAST(coalesce(SUM(surface_campaign_count) FILTER (surface = '{s}'), 0) AS BIGINT) AS {s}" for s in SURFACES
    ) + f" FROM ({SURFACE}) GROUP BY 1"),
    "surface_pivot_billions": q("SELECT quarter, " + ", ".join(
        f"coalesce(SUM(impression_billionth) FILTER (surface = '{s}'), 0) AS {s}" for s in SURFACES
    ) + f" FROM ({SURFACE}) GROUP BY 1"),
    "action_qoq": q(f"SELECT *, {QUARTER_CHANGES} FROM (SELECT surface, action, {QUARTER_SUMS} FROM r WHERE surface IS NOT NULL GROUP BY 1, 2)"),
    "overall_rates": q(counts("surface, quarter", "overall")),
    "campaign_rates": q(RATES),
    "campaign_top_bottom": q(f""", c AS (SELECT *,
          row_number() OVER (PARTITION BY surface ORDER BY campaign_ctr DESC, campaign_id) AS best,
          row_number() OVER (PARTITION BY surface ORDER BY campaign_ctr, campaign_id) AS worst
        FROM ({RATES}) WHERE campaign_ctr IS NOT NULL)
        SELECT * EXCLUDE (best, worst), 'top' AS list FROM c WHERE best <= 5
        UNION ALL SELECT * EXCLUDE (best, worst), 'bottom' FROM c WHERE worst <= 5"""),
    "new_campaigns": q(f"""SELECT DISTINCT upper(campaign_id) AS campaign_id FROM r WHERE quarter = '{NOW}'
        EXCEPT SELECT upper(campaign_id) FROM r WHERE quarter <> '{NOW}'"""),
    "user_distribution": with_roles(["user_counts"], f"SELECT * FROM ({distribution('campaign')} UNION ALL {distribution('impression')})"),
    "frequency_efficiency": with_roles(
        ["campaign_frequency"],
        f"""SELECT quarter, campaign_id, CAST(impression AS INTEGER) AS impression, uu, CAST(total_click AS BIGINT) AS total_click,
        CAST(total_dismiss AS BIGINT) AS total_dismiss, total_impression, ctr, dismiss_rate, round(uu / 1e6, 6) AS uu_million,
        round(ctr * 100, 6) AS ctr_pct, round(dismiss_rate * 100, 6) AS dismiss_rate_pct FROM (
          SELECT *, uu * impression AS total_impression, {even('CAST(total_click AS DOUBLE) / (uu * impression)', 4)} AS ctr,
            {even('CAST(total_dismiss AS DOUBLE) / (uu * impression)', 4)} AS dismiss_rate
          FROM campaign_frequency WHERE uu > 2 AND impression > 0 AND impression < 16)""",
    ),
    "date_values": """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day_code, strftime(o_orderdate, '%Y-%m-%d') AS day,
        strftime(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH, '%Y-%m-%d') AS three_months_before,
        CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(trunc(CAST(o_totalprice AS DOUBLE)) AS BIGINT) END AS whole,
        CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 5 THEN 'treatment' ELSE 'control' END AS arm
        FROM orders""",
}
