"""SQL of the calibration queries."""

from oracle.roles import with_roles

START, END = "1996-01-01", "2000-12-31"
Z = "1.959963984540054::DOUBLE"


def d(text: str) -> str:
    return f"CAST({text} AS DOUBLE)"


def R(text: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({text} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {name}"


SLA = "CASE WHEN conversions > 0 AND conversions_pred / conversions > 0.8 AND conversions_pred / conversions < 1.2 THEN 1 ELSE 0 END"


def items(sim: bool = False, where: str = "true", name: str = "items") -> str:
    key = "sim_id, line_item_id" if sim else "line_item_id"
    return f""", {name} AS (
      SELECT *, CASE WHEN sla_flag = 1 THEN revenue ELSE 0 END AS rev_sla FROM (
        SELECT *, {SLA} AS sla_flag, CASE WHEN conversions = 0 THEN 0 ELSE conversions_pred / conversions END AS calibration
        FROM (SELECT {key}, COUNT(serve_item_id) AS impressions, SUM(conversions) AS conversions,
                SUM(predicted_conversions) AS conversions_pred, SUM(revenue) AS revenue
              FROM served_items WHERE {where} GROUP BY {key})))"""


def ratio(x: str, y: str) -> str:
    return f"CASE WHEN avg({y}) = 0 OR avg({y}) IS NULL THEN 0 ELSE avg({x}) / avg({y}) END"


def variance(x: str, y: str) -> str:
    return (
        f"CASE WHEN count({y}) <= 1 OR avg({y}) = 0 THEN 0 ELSE (var_pop({x}) / avg({y})^2 "
        f"+ var_pop({y}) * avg({x})^2 / avg({y})^4 - 2 * covar_samp({x}, {y}) * avg({x}) / avg({y})^3) / count({y}) END"
    )


IN_BAND = (
    "(CASE WHEN conversions <> 0 AND conversions_pred / nullif(conversions, 0) BETWEEN 0.8 AND 1.2 "
    "THEN revenue ELSE 0.0::DOUBLE END)"
)


def readout(digits: int = 10) -> str:
    return f"""COUNT(*) AS line_items,
      {R(ratio('conversions_pred', 'conversions'), 'calibration', digits)},
      {R(variance('conversions_pred', 'conversions'), 'calibration_var', digits)},
      {R(ratio(IN_BAND, 'revenue'), 'pct_rev_sla', digits)}, {R(variance(IN_BAND, 'revenue'), 'pct_rev_sla_var', digits)},
      {R('SUM(rev_sla) / SUM(revenue)', 'pct_rev_sla_open', digits)}"""


DEEP = (
    "('APP_REENGAGE_PURCHASE', 'APP_PURCHASE', 'APP_PURCHASE_VO', 'APP_ADD_TO_CART', 'APP_SIGNUP', "
    "'APP_AD_VIEW', 'APP_ACHIEVEMENT_UNLOCKED', 'APP_LEVEL_COMPLETE')"
)
# One row per combination is written out in the order in which the windows are tried.
CONVERSIONS = f"""CASE
  WHEN model_type LIKE '%7_0%' AND optimization_goal IN {DEEP} AND optimization_goal LIKE '%_VO' THEN conversions_value_2_0
  WHEN model_type LIKE '%7_0%' AND optimization_goal IN {DEEP} THEN conversions_2_0
  WHEN model_type LIKE '%7_0%' AND optimization_goal LIKE '%_VO' THEN conversions_value_7_0
  WHEN model_type LIKE '%7_0%' THEN conversions_7_0
  WHEN optimization_goal IN {DEEP} AND optimization_goal LIKE '%_VO' THEN conversions_value_2_1
  WHEN optimization_goal IN {DEEP} THEN conversions_2_1
  WHEN optimization_goal LIKE '%_VO' THEN conversions_value_1_1
  WHEN optimization_goal IS NULL OR optimization_goal LIKE 'PIXEL%' THEN conversions_1_1
  ELSE conversions_2_1 END"""
PREDICTED = """CASE WHEN optimization_goal LIKE '%_VO' OR optimization_goal LIKE '%ROAS'
  THEN predicted_conversions_value ELSE predicted_conversions END"""
NO_ANOMALY = "coalesce(NOT list_contains(app_anomaly_severity, 2), true)"
CLEAN = f"{NO_ANOMALY} AND is_house_ad IS FALSE AND optimization_goal <> 'IMPRESSIONS'"
DATES = f"served_date BETWEEN DATE '{START}' AND DATE '{END}'"
SUMS = f"""SUM(impressions)::BIGINT AS impressions, SUM({CONVERSIONS}) AS conversions,
  SUM({PREDICTED}) AS predicted_conversions, SUM(revenue) AS revenue"""
ROUNDED_SUMS = "impressions, " + ", ".join(R(c, c) for c in ("conversions", "predicted_conversions", "revenue"))
FIVE = "line_item_id, model_type, bid_strategy, optimization_goal, winner_bgid"


def traffic(period: str | None) -> str:
    keys = FIVE
    if period == "day":
        keys = f"CAST(served_date AS VARCHAR) AS day, {FIVE}, ad_account_id, adv_size_by_revenue"
    if period == "week":
        keys = f"CAST(CAST(date_trunc('week', served_date) AS DATE) AS VARCHAR) AS week, {FIVE}, ad_account_id, adv_size_by_revenue"
    return f"SELECT {keys}, {SUMS} FROM ad_facts WHERE {DATES} AND {CLEAN} GROUP BY ALL"


def sizes(days: int) -> str:
    return f"""SELECT ad_account_id, adv_size_by_revenue FROM (
      SELECT ad_account_id, adv_size_by_revenue, row_number() OVER (PARTITION BY ad_account_id
        ORDER BY account_updated_at DESC, adv_size_by_revenue DESC) AS ranked
      FROM ad_facts WHERE served_date BETWEEN DATE '{START}' - {days} AND DATE '{START}') WHERE ranked = 1"""


def ab(clean: str) -> str:
    return f"""SELECT line_item_id, f.ad_account_id, coalesce(s.adv_size_by_revenue, 'Unknown') AS adv_size_by_revenue,
        model_type, bid_strategy, optimization_goal,
        CASE WHEN bgid = 'BG_C' THEN 'control' ELSE 'treatment' END AS treatment_group, {SUMS}
      FROM ad_facts f LEFT JOIN ({sizes(7)}) s ON f.ad_account_id = s.ad_account_id
      WHERE {DATES} AND bgid IN ('BG_C', 'BG_T') AND optimization_goal <> 'IMPRESSIONS' AND {clean} GROUP BY ALL"""


SPAM = f"is_pixel_spammy = false AND {NO_ANOMALY} AND is_house_ad IS FALSE"
METRICS = ("impressions", "conversions", "predicted_conversions", "revenue")


def wide(keys: str) -> str:
    columns = ", ".join(
        f"coalesce(SUM({m}) FILTER (treatment_group = '{a}'), 0) AS {m}_{a}"
        for m in METRICS for a in ("control", "treatment")
    )
    return f"SELECT {keys}, {columns} FROM ab GROUP BY ALL"


WIDE_KEYS = "line_item_id, bid_strategy, optimization_goal"
WIDE = f", ab AS ({ab(SPAM)}), wide AS ({wide(WIDE_KEYS)})"
PAIRED = [f"{m}_{a}" for a in ("control", "treatment") for m in ("predicted_conversions", "conversions", "revenue")]
PAIRED_SUMS = ", ".join(f"SUM({c}) AS {c}" for c in PAIRED)


def moments() -> str:
    parts = []
    for arm in ("control", "treatment"):
        pred, conv, rev = (f"{m}_{arm}" for m in ("predicted_conversions", "conversions", "revenue"))
        inside = f"(CASE WHEN {pred} / nullif({conv}, 0) BETWEEN 0.8 AND 1.2 THEN {rev} ELSE 0.0::DOUBLE END)"
        a = arm[0]
        parts += [
            f"{ratio(pred, conv)} AS cali_{a}", f"{variance(pred, conv)} AS cali_{a}_var",
            f"{ratio(inside, rev)} AS perc_rev_sla_{a}", f"{variance(inside, rev)} AS perc_rev_sla_{a}_var",
        ]
    return ", ".join(parts)


def root(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN sqrt(greatest({x}, 0)) END"


def differences(digits: int) -> str:
    out = []
    for m in ("cali", "perc_rev_sla"):
        diff = "abs(cali_t - 1) - abs(cali_c - 1)" if m == "cali" else "perc_rev_sla_t - perc_rev_sla_c"
        se = root(f"({m}_t_var + {m}_c_var)")
        for a in ("t", "c"):
            out += [R(f"{m}_{a}", f"{m}_{a}", digits),
                    R(f"({m}_{a} - {Z} * ({root(f'{m}_{a}_var')}))", f"{m}_{a}_lo", digits),
                    R(f"({m}_{a} + {Z} * ({root(f'{m}_{a}_var')}))", f"{m}_{a}_hi", digits)]
        out += [
            R(f"({diff})", f"{m}_d", digits), R(f"({se})", f"{m}_d_se", digits),
            R(f"(({diff}) - {Z} * ({se}))", f"{m}_d_lo", digits), R(f"(({diff}) + {Z} * ({se}))", f"{m}_d_hi", digits),
            R(f"(2 * {Z} * ({se}))", f"{m}_d_ci_width", digits),
            R(f"(2 * {Z} * ({se}) / nullif(abs({diff}), 0))", f"{m}_d_ci_width_rel", digits),
        ]
    return ", ".join(out)


def ab_levels(item: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f""", level1 AS (
        SELECT {lead}'Overall' AS optimization_goal, {item}, {PAIRED_SUMS} FROM wide GROUP BY ALL
        UNION ALL SELECT {lead}optimization_goal, {item}, {PAIRED_SUMS} FROM wide GROUP BY ALL),
      level2 AS (SELECT {lead}optimization_goal, {moments()} FROM level1 GROUP BY ALL)"""


def ab_readout(item: str, by: str = "", digits: int = 8) -> str:
    lead = f"{by}, " if by else ""
    return f"{ab_levels(item, by)} SELECT {lead}optimization_goal, {differences(digits)} FROM level2"


ERR_SYM = "CASE WHEN r > 1 THEN 1 - 1 / r ELSE 1 - r END"
WEIGHTED = """, w AS (SELECT *, revenue AS w, conversions_pred / nullif(conversions, 0) AS r,
    CASE WHEN conversions > 0 THEN revenue END AS wd FROM items)"""

CELLS = f""", grid AS (
      SELECT * FROM (VALUES ('impressions_control'), ('conversions_control')) a(dimension),
        (VALUES ('left'), ('right')) b(direction), (SELECT unnest(range(10)) AS pct_cut)),
    long AS (SELECT 'impressions_control' AS dimension, impressions_control AS v, * FROM wide
             UNION ALL SELECT 'conversions_control', conversions_control, * FROM wide),
    thr AS (SELECT g.dimension, g.direction, g.pct_cut,
        CASE WHEN g.direction = 'left' THEN quantile_cont(l.v, g.pct_cut / 100.0) ELSE quantile_cont(l.v, (100 - g.pct_cut) / 100.0) END AS t
      FROM grid g JOIN long l ON l.dimension = g.dimension GROUP BY 1, 2, 3),
    kept AS (SELECT t.direction, t.pct_cut, l.* FROM thr t JOIN long l ON l.dimension = t.dimension
        AND CASE WHEN t.direction = 'left' THEN l.v >= t.t ELSE l.v <= t.t END
      UNION ALL SELECT 'none', -1, * FROM long),
    level1 AS (SELECT dimension, direction, pct_cut, 'Overall' AS optimization_goal, line_item_id, {PAIRED_SUMS} FROM kept GROUP BY ALL
      UNION ALL SELECT dimension, direction, pct_cut, optimization_goal, line_item_id, {PAIRED_SUMS} FROM kept
        WHERE optimization_goal = 'APP_INSTALLS' GROUP BY ALL),
    level2 AS (SELECT dimension, direction, pct_cut, optimization_goal, {moments()} FROM level1 GROUP BY ALL),
    cells AS (SELECT dimension, direction, pct_cut, optimization_goal, {differences(14)} FROM level2),
    sums AS (SELECT dimension, direction, pct_cut, SUM(revenue_control + revenue_treatment) AS rev,
        SUM(conversions_control + conversions_treatment) AS conv FROM kept GROUP BY ALL)"""
# quantile_cont takes constant shares only, so the thresholds are written out per share.
SHARES = ", ".join(f"{p / 100!r}::DOUBLE" for p in range(10))
UPPER = ", ".join(f"{(100 - p) / 100!r}::DOUBLE" for p in range(10))
CELLS = CELLS.replace(
    CELLS[CELLS.index("thr AS ("):CELLS.index("kept AS (")],
    f"""q AS (SELECT dimension, quantile_cont(v, [{SHARES}]) AS lo, quantile_cont(v, [{UPPER}]) AS hi FROM long GROUP BY 1),
    thr AS (SELECT g.*, CASE WHEN g.direction = 'left' THEN lo[g.pct_cut + 1] ELSE hi[g.pct_cut + 1] END AS t
      FROM grid g JOIN q ON q.dimension = g.dimension),
    """,
)


def cut(column: str, name: str) -> str:
    return (
        f"{R(f'(b.{column} - s.{column})', f'{name}_cut_out', 5)}, "
        f"{R(f'((b.{column} - s.{column}) / b.{column} * 100)', f'{name}_cut_out_pct', 5)}"
    )


def gain(m: str) -> str:
    w = f"{m}_d_ci_width"
    return (
        f"{R(f'c.{w}', w, 5)}, {R(f'(z.{w} - c.{w})', f'{m}_d_ci_reduction', 5)}, "
        f"{R(f'((z.{w} - c.{w}) / z.{w} * 100)', f'{m}_d_ci_reduction_pct', 5)}"
    )


def whole(name: str) -> str:
    """Counts stay whole numbers, amounts are rounded."""
    return f"CAST({name} AS BIGINT) AS {name}" if name.startswith("impressions") else R(name, name)


SUM_LIST = ("revenue", "impressions", "rev_sla", "conversions", "conversions_pred")
TOTALS = ", ".join(f"CAST(SUM({c}) AS DOUBLE) AS {c}" for c in SUM_LIST)
TOTALS_OUT = ", ".join(whole(c) for c in SUM_LIST) + ", " + R("rev_sla / revenue", "pct_rev_sla") + ", " + R(
    "CASE WHEN conversions = 0 THEN 0 ELSE conversions_pred / conversions END", "calibration"
)
SIMS = """, sims AS (SELECT sim_id, SUM(rev_sla) / SUM(revenue) AS pct_rev_sla,
    SUM(conversions_pred) / SUM(conversions) AS calibration FROM items WHERE sim_id IS NOT NULL GROUP BY 1)"""


def interval(m: str) -> str:
    length = f"(quantile_cont({m}, 0.975) - quantile_cont({m}, 0.025))"
    return f"""SELECT '{m}' AS metric, {R(f'avg({m})', 'mean', 8)}, {R(length, 'ci_length', 8)},
      {R(f'{length} / 2', 'half_ci', 8)}, {R(f'{length} / avg({m})', 'relative_length', 8)} FROM sims"""


def outlier(c: str) -> str:
    return (
        f"CAST({c} < q.{c}[1] - 1.5 * (q.{c}[2] - q.{c}[1]) OR {c} > q.{c}[2] + 1.5 * (q.{c}[2] - q.{c}[1]) AS INTEGER) "
        f"AS {c}_outlier"
    )


def histogram(value: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f""", v AS (SELECT {lead}{value} AS v FROM items), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM v)
      SELECT {lead}bin, COUNT(*) AS rows, {R('any_value(lo + (bin - 1) * w)', 'bin_low')}, {R('any_value(lo + bin * w)', 'bin_high')}
      FROM (SELECT *, CAST(least(floor((v - lo) / w) + 1, 50) AS INTEGER) AS bin FROM v, e) GROUP BY {lead}bin"""


def deciles(rank_by: str) -> str:
    columns = ", ".join(
        f"{R(f'SUM({m})', m)}, {R(f'SUM(SUM({m})) OVER (ORDER BY decile) / SUM(SUM({m})) OVER () * 100', f'{m}_cum_pct')}"
        for m in ("revenue_control", "conversions_control")
    )
    return f"""SELECT '{rank_by}' AS rank_by, decile, COUNT(*) AS rows, {columns}
      FROM (SELECT *, CAST(greatest(1, ceil((rn - 1) * 10 / (n - 1))) AS INTEGER) AS decile FROM (
        SELECT *, row_number() OVER (ORDER BY {rank_by}, line_item_id, bid_strategy, optimization_goal) AS rn,
          COUNT(*) OVER () AS n FROM wide)) GROUP BY decile"""


def flagged(keys: str, where: str = "true") -> str:
    return f"""SELECT *, CASE WHEN conversions > 0 AND predicted_conversions / nullif(conversions, 0) > 0.8
          AND predicted_conversions / nullif(conversions, 0) < 1.2 THEN revenue ELSE 0 END AS rev_sla
      FROM (SELECT {keys}, SUM(conversions) AS conversions, SUM(predicted_conversions) AS predicted_conversions,
        SUM(revenue) AS revenue FROM t WHERE {where} GROUP BY ALL)"""


def weekly(keys: str, inner: str, where: str = "true") -> str:
    return f"""SELECT {keys}, SUM(conversions) AS conversions, SUM(predicted_conversions) AS predicted_conversions,
      SUM(revenue) AS revenue, SUM(rev_sla) AS rev_sla, SUM(rev_sla) / SUM(revenue) AS pct_rev_sla
      FROM ({flagged(inner, where)}) GROUP BY ALL"""


ACCOUNT = "week, ad_account_id, adv_size_by_revenue"
WEEK_T = f", t AS ({traffic('week')})"
WEEK_OUT = ", ".join(R(c, c) for c in ("conversions", "predicted_conversions", "revenue", "rev_sla", "pct_rev_sla"))
BY_SIZE = weekly("week, adv_size_by_revenue", ACCOUNT)
SIZES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "GROWTH", "HOUSEHOLD", "MACHINERY")
served = ["served_items"]
facts = ["ad_facts"]

SQL = {
    "calibration_overall": with_roles(served, items() + f"SELECT {readout()} FROM items"),
    "calibration_by_goal": with_roles(
        served,
        items(where="optimization_goal = 'APP_INSTALLS'", name="a") + items(where="optimization_goal = 'PIXEL_PURCHASE'", name="b")
        + items(where="optimization_goal = 'APP_PURCHASE'", name="c")
        + f"""SELECT 'APP_INSTALLS' AS goal, {readout()} FROM a UNION ALL SELECT 'PIXEL_PURCHASE', {readout()} FROM b
        UNION ALL SELECT 'APP_PURCHASE', {readout()} FROM c""",
    ),
    "item_sample": with_roles(
        served,
        items() + f"""SELECT line_item_id, {R('revenue', 'revenue')} FROM items
        WHERE ('0x' || substr(md5('0:' || line_item_id), 1, 8))::BIGINT < 429496729.6::DOUBLE""",
    ),
    "line_item_sla": with_roles(
        served,
        items(True) + f"""SELECT sim_id, line_item_id, impressions, sla_flag, {R('conversions', 'conversions')},
        {R('conversions_pred', 'conversions_pred')}, {R('revenue', 'revenue')}, {R('rev_sla', 'rev_sla')},
        {R('calibration', 'calibration')} FROM items""",
    ),
    "traffic_total": with_roles(facts, f"SELECT {FIVE}, {ROUNDED_SUMS} FROM ({traffic(None)})"),
    "traffic_daily": with_roles(
        facts, f"SELECT day, {FIVE}, ad_account_id, adv_size_by_revenue, {ROUNDED_SUMS} FROM ({traffic('day')})"
    ),
    "traffic_weekly": with_roles(
        facts, f"SELECT week, {FIVE}, ad_account_id, adv_size_by_revenue, {ROUNDED_SUMS} FROM ({traffic('week')})"
    ),
    "account_sizes": with_roles(facts, sizes(700)),
    "ab_rollup": with_roles(
        facts,
        f"""SELECT line_item_id, ad_account_id, adv_size_by_revenue, model_type, bid_strategy, optimization_goal,
        treatment_group, {ROUNDED_SUMS} FROM ({ab(SPAM)})""",
    ),
    "ab_rollup_goal_unfiltered": with_roles(
        facts,
        f"""SELECT line_item_id, ad_account_id, adv_size_by_revenue, model_type, bid_strategy, optimization_goal,
        treatment_group, {ROUNDED_SUMS} FROM ({ab("optimization_goal = 'PIXEL_PURCHASE'")})""",
    ),
    "ab_wide": with_roles(
        facts,
        WIDE + f"SELECT {WIDE_KEYS}, " + ", ".join(whole(f"{m}_{a}") for m in METRICS for a in ("control", "treatment")) + " FROM wide",
    ),
    "ab_readout": with_roles(facts, WIDE + ab_readout("line_item_id")),
    "ab_readout_text": with_roles(
        facts,
        WIDE + ab_levels("line_item_id") + f", shown AS (SELECT optimization_goal, {differences(8)} FROM level2) SELECT optimization_goal, "
        + ", ".join(
            f"printf('%.3f (%.3f, %.3f)', cali_{a}, cali_{a}_lo, cali_{a}_hi) AS cali_{a}_text, "
            f"printf('%.2f%% (%.2f%%, %.2f%%)', perc_rev_sla_{a} * 100, perc_rev_sla_{a}_lo * 100, perc_rev_sla_{a}_hi * 100) AS perc_rev_sla_{a}_text"
            for a in "tc"
        ) + " FROM shown",
    ),
    "ab_readout_by_size": with_roles(
        facts,
        f", ab AS ({ab(SPAM)}), wide AS ({wide('ad_account_id, adv_size_by_revenue, optimization_goal')})"
        + ab_readout("ad_account_id", "adv_size_by_revenue"),
    ),
    "weighted_calibration": with_roles(
        served,
        items() + WEIGHTED + f"""SELECT {R(ratio('w * r', 'wd'), 'weighted_calibration', 10)},
        {R(variance('w * r', 'wd'), 'weighted_calibration_var', 10)},
        {R('avg(w * CASE WHEN conversions = 0 THEN conversions_pred + 1 ELSE r END) / avg(w)', 'weighted_calibration_smoothed', 10)},
        COUNT(*) FILTER (conversions = 0) AS rows_without_conversions FROM w""",
    ),
    "weighted_abs_error": with_roles(
        served,
        items(True) + WEIGHTED + f"""SELECT sim_id, {R(ratio('w * abs(r - 1)', 'wd'), 'weighted_abs_error', 8)},
        {R(variance('w * abs(r - 1)', 'wd'), 'weighted_abs_error_var', 8)},
        {R(ratio(f'w * ({ERR_SYM})', 'wd'), 'weighted_abs_error_symmetric', 8)},
        {R(variance(f'(w * ({ERR_SYM}))', 'wd'), 'weighted_abs_error_symmetric_var', 8)} FROM w WHERE sim_id IS NOT NULL GROUP BY 1""",
    ),
    "trim_rows": with_roles(
        facts,
        WIDE + f"SELECT {WIDE_KEYS}, " + ", ".join(whole(f"{m}_{a}") for m in METRICS for a in ("control", "treatment"))
        + """ FROM wide, (SELECT quantile_cont(revenue_control, 0.05::DOUBLE) AS lo, quantile_cont(revenue_control, 0.95::DOUBLE) AS hi FROM wide)
        WHERE revenue_control BETWEEN lo AND hi""",
    ),
    "trim_grid": with_roles(
        facts,
        WIDE + CELLS + f"""SELECT c.dimension, c.direction, CAST(c.pct_cut AS DOUBLE) AS pct_cut, c.optimization_goal,
        {cut('rev', 'revenue')}, {cut('conv', 'conversion')}, {gain('cali')}, {gain('perc_rev_sla')}
        FROM cells c JOIN cells z ON z.dimension = c.dimension AND z.optimization_goal = c.optimization_goal AND z.direction = 'none'
        JOIN sums s ON s.dimension = c.dimension AND s.direction = c.direction AND s.pct_cut = c.pct_cut
        JOIN sums b ON b.dimension = c.dimension AND b.direction = 'none' WHERE c.direction <> 'none'""",
    ),
    "trim_estimates": with_roles(
        facts,
        WIDE + CELLS + "SELECT dimension, direction, CAST(pct_cut AS DOUBLE) AS pct_cut, optimization_goal, "
        + ", ".join(R(c, c, 7) for c in ("cali_d", "cali_d_lo", "cali_d_hi", "perc_rev_sla_d", "perc_rev_sla_d_lo", "perc_rev_sla_d_hi"))
        + " FROM cells WHERE direction <> 'none'",
    ),
    "sim_totals": with_roles(
        served, items(True) + f"SELECT sim_id, {TOTALS_OUT} FROM (SELECT sim_id, {TOTALS} FROM items WHERE sim_id IS NOT NULL GROUP BY 1)"
    ),
    "population_totals": with_roles(served, items() + f"SELECT {TOTALS_OUT} FROM (SELECT {TOTALS} FROM items)"),
    "sim_interval": with_roles(
        served, items(True) + SIMS + f"{interval('pct_rev_sla')} UNION ALL {interval('calibration')}"
    ),
    "sim_variance": with_roles(
        served,
        items(True) + SIMS + f""", a AS (SELECT var_samp(calibration) AS c, var_samp(pct_rev_sla) AS p FROM sims),
        b AS (SELECT avg(cv) AS c, avg(pv) AS p FROM (SELECT sim_id, {variance('conversions_pred', 'conversions')} AS cv,
          {variance(IN_BAND, 'revenue')} AS pv FROM items WHERE sim_id IS NOT NULL GROUP BY 1))
        SELECT 'calibration' AS metric, {R('a.c', 'empirical_var', 9)}, {R('b.c', 'delta_var', 9)}, {R('a.c / b.c', 'ratio', 9)} FROM a, b
        UNION ALL SELECT 'pct_rev_sla', round(a.p, 9), round(b.p, 9), round(a.p / b.p, 9) FROM a, b""",
    ),
    "iqr_outliers": with_roles(
        served,
        items() + f"""SELECT line_item_id, {outlier('rev_sla')}, {outlier('calibration')}, {outlier('revenue')}
        FROM items, (SELECT quantile_cont(rev_sla, [0.25, 0.75]) AS rev_sla, quantile_cont(calibration, [0.25, 0.75]) AS calibration,
          quantile_cont(revenue, [0.25, 0.75]) AS revenue FROM items) q""".replace("CAST(rev_sla <", "CAST(items.rev_sla <")
        .replace("CAST(calibration <", "CAST(items.calibration <").replace("CAST(revenue <", "CAST(items.revenue <")
        .replace("OR rev_sla >", "OR items.rev_sla >").replace("OR calibration >", "OR items.calibration >")
        .replace("OR revenue >", "OR items.revenue >"),
    ),
    "histogram_bins": with_roles(served, items() + histogram("ln(revenue + 1e-6)", "sla_flag")),
    "histogram_impressions": with_roles(served, items() + histogram("CAST(impressions AS DOUBLE)")),
    "decile_cumulative": with_roles(
        facts,
        WIDE + " UNION ALL ".join(deciles(r) for r in ("impressions_control", "conversions_control")),
    ),
    "weekly_sla": with_roles(
        facts, WEEK_T + f"SELECT week, {WEEK_OUT} FROM ({weekly('week', 'week, line_item_id')})"
    ),
    "weekly_sla_stored": with_roles(
        facts, WEEK_T + f"SELECT week, {WEEK_OUT} FROM ({weekly('week', 'week, line_item_id')})"
    ),
    "weekly_sla_by_size": with_roles(
        facts,
        WEEK_T + f"SELECT week, adv_size_by_revenue, {WEEK_OUT} FROM ("
        + weekly("week, adv_size_by_revenue", ACCOUNT, "optimization_goal = 'APP_INSTALLS'") + ")",
    ),
    "weekly_cv": with_roles(
        facts,
        WEEK_T + f"""SELECT label, {R('avg(p)', 'mean', 8)}, {R('stddev_samp(p)', 'std', 8)},
        {R('stddev_samp(p) / nullif(avg(p), 0)', 'cv', 8)}, {R('stddev_samp(p) / nullif(avg(p), 0) * 100', 'cv_pct', 8)} FROM (
          SELECT 'Line Item Level' AS label, pct_rev_sla AS p FROM ({weekly('week', 'week, line_item_id')})
          UNION ALL SELECT adv_size_by_revenue, pct_rev_sla FROM ({BY_SIZE})) GROUP BY 1""",
    ),
    "weekly_size_share": with_roles(
        facts,
        WEEK_T + f"""SELECT week, adv_size_by_revenue, {R('revenue', 'revenue')},
        {R('revenue / SUM(revenue) OVER (PARTITION BY week) * 100', 'pct_revenue')} FROM ({BY_SIZE})""",
    ),
    "weekly_size_pivot": with_roles(
        facts,
        WEEK_T + "SELECT week, " + ", ".join(
            R(f"coalesce(SUM(revenue) FILTER (adv_size_by_revenue = '{s}'), 0) / 1e6", s, 10) for s in SIZES
        ) + f" FROM ({BY_SIZE}) GROUP BY 1",
    ),
}
