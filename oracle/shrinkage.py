"""SQL of the shrinkage and A/A queries."""

from oracle.calibration import R, SLA, items
from oracle.roles import with_roles

P = "least(greatest(CAST(sla_flag AS DOUBLE), 1e-6), 1 - 1e-6)"
NU = "sqrt(greatest(CAST(conversions AS DOUBLE), 1e-6))"


def prior(source: str, name: str = "pr") -> str:
    return f", {name} AS (SELECT line_item_id, {P} * {NU} AS alpha, (1 - {P}) * {NU} AS beta FROM {source})"


POP = items(name="pop")
GOAL = items(where="optimization_goal = 'APP_INSTALLS'", name="goal_items") + prior("goal_items")
N = "sqrt(CAST(i.conversions AS DOUBLE))"


def posterior(source: str, join: str = "LEFT JOIN") -> str:
    return f"""SELECT *, alpha_post / (alpha_post + beta_post) AS post_sla_li,
      alpha_post / (alpha_post + beta_post) * CAST(revenue AS DOUBLE) AS rev_sla_li, alpha / (alpha + beta) AS prior_p FROM (
      SELECT i.*, pr.alpha, pr.beta, pr.alpha + i.sla_flag * {N} AS alpha_post, pr.beta + {N} - i.sla_flag * {N} AS beta_post
      FROM {source} i {join} pr ON pr.line_item_id = i.line_item_id)"""


def totals(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}SUM(revenue) AS revenue, SUM(conversions) AS conversions, SUM(conversions_pred) AS conversions_pred,
      CASE WHEN SUM(conversions) > 0 THEN SUM(conversions_pred) / SUM(conversions) ELSE 0 END AS calibration, avg(sla_flag) AS avg_sla_rate,
      SUM(rev_sla) / SUM(revenue) AS pct_rev_sla, coalesce(SUM(rev_sla_li), 0) / SUM(revenue) AS pct_rev_sla_li
      FROM post {f"WHERE {by} IS NOT NULL" if by else ""} GROUP BY ALL"""


TOTALS_OUT = ", ".join(
    R(c, c) for c in ("revenue", "conversions", "conversions_pred", "calibration", "avg_sla_rate", "pct_rev_sla", "pct_rev_sla_li")
)
SIMS = items(True) + GOAL + f", post AS ({posterior('items')}), sims AS ({totals('sim_id')})"


def summary(m: str) -> str:
    return f"SELECT '{m}' AS metric, {R(f'avg({m})', 'mean', 8)}, {R(f'stddev_samp({m})', 'std', 8)}, {R(f'min({m})', 'min', 8)}, {R(f'max({m})', 'max', 8)} FROM sims"


C = "CAST(conversions AS DOUBLE)"
RATIO = f"(CASE WHEN conversions > 0 THEN conversions_pred / nullif({C}, 0) END)"
W = f"sqrt({C} + 1e-6)"
AA = f""", aa AS (SELECT *, CASE WHEN sla_flag = 1 THEN revenue ELSE 0 END AS rev_sla FROM (SELECT *, {SLA} AS sla_flag,
    CASE WHEN conversions = 0 THEN 0 ELSE conversions_pred / conversions END AS calibration FROM (
    SELECT iteration_id AS sim_id, line_item_id, 'a1' AS arm, conv_a1 AS conversions, pred_conv_a1 AS conversions_pred, rev_a1 AS revenue FROM aa_wide
    UNION ALL SELECT iteration_id, line_item_id, 'a2', conv_a2, pred_conv_a2, rev_a2 FROM aa_wide)))"""
AA_NORMAL = AA + POP + prior("pop") + f""", arms AS (SELECT sim_id, arm,
      SUM(revenue * alpha_post / (alpha_post + beta_post)) / SUM(revenue) AS mu,
      SUM(revenue^2 * alpha_post * beta_post / ((alpha_post + beta_post)^2 * (alpha_post + beta_post + 1))) / SUM(revenue)^2 AS var
    FROM ({posterior('aa', 'JOIN')}) WHERE sim_id IS NOT NULL GROUP BY 1, 2),
  pairs AS (SELECT x.sim_id, x.mu AS mu_a1, y.mu AS mu_a2, x.var AS var_a1, y.var AS var_a2,
      (y.mu - x.mu) / sqrt(x.var + y.var) AS z FROM arms x JOIN arms y ON x.sim_id = y.sim_id AND x.arm = 'a1' AND y.arm = 'a2'),
  decided AS (SELECT *, CAST(abs(z) > 1.959963984540054::DOUBLE AS INTEGER) AS false_positive FROM pairs)"""
# Draws agree with the normal check everywhere, and with its decision where that is clear of the bound.
CLEAR = "CASE WHEN abs(abs(z) - 1.959963984540054::DOUBLE) > 0.6::DOUBLE THEN false_positive END"
TRIES, SLOTS = 8, 25


def mixed(columns: dict[str, tuple[str, str]], source: str) -> str:
    """Columns of uniforms from hashes of key and counter: name to (counter, where it is wanted). A subquery per step."""
    steps = (
        lambda n, c: f"xor((k0 + {c} * 2654435769::UBIGINT) % 4294967296::UBIGINT, k1)",
        lambda n, c: f"(xor({n}, {n} >> 16) * 2146121005::UBIGINT) % 4294967296::UBIGINT",
        lambda n, c: f"(xor({n}, {n} >> 15) * 2221713035::UBIGINT) % 4294967296::UBIGINT",
        lambda n, c: f"(CAST(xor({n}, {n} >> 16) AS DOUBLE) + 0.5::DOUBLE) / 4294967296::DOUBLE",
    )
    for i, step in enumerate(steps):
        found = ", ".join(f"CASE WHEN {w} THEN {step(n, c)} END AS {n}" for n, (c, w) in columns.items())
        source = f"SELECT *, {found} FROM ({source})" if i == 0 else f"SELECT * REPLACE ({found}) FROM ({source})"
    return source


def gamma_tries(source: str) -> str:
    """Logarithms l_x and l_y of gamma draws of shapes x and y by Marsaglia and Tsang, as in shrinkage.hashed_draws."""
    sql = f"SELECT *, NULL::DOUBLE AS l_x, NULL::DOUBLE AS l_y, 1::DOUBLE AS v_x, 1::DOUBLE AS v_y FROM ({source})"
    for t in range(TRIES):
        sql = mixed({f"u{i}_{g}": (f"(c_{g} + {3 * t + i})", f"l_{g} IS NULL") for g in "xy" for i in range(3)}, sql)
        x = ", ".join(f"CASE WHEN l_{g} IS NULL THEN sqrt(-2 * ln(u0_{g})) * cos(2 * pi() * u1_{g}) END AS u0_{g}" for g in "xy")
        v = ", ".join(f"CASE WHEN l_{g} IS NULL THEN 1 + u0_{g} / sqrt(9 * d_{g}) END AS v_{g}" for g in "xy")
        log_v = {g: f"3 * ln(greatest(v_{g}, 1e-300::DOUBLE))" for g in "xy"}
        taken = ", ".join(
            f"""CASE WHEN l_{g} IS NOT NULL THEN l_{g} WHEN v_{g} > 0
              AND ln(u2_{g}) < u0_{g} * u0_{g} / 2 + d_{g} * (1 - v_{g} * v_{g} * v_{g} + {log_v[g]}) THEN {log_v[g]} END AS l_{g}"""
            for g in "xy"
        )
        for columns in (x, v, taken):
            sql = f"SELECT * REPLACE ({columns}) FROM ({sql})"
        sql = f"SELECT * EXCLUDE ({', '.join(f'u{i}_{g}' for g in 'xy' for i in range(3))}) FROM ({sql})"
    sql = mixed({f"w_{g}": (f"(c_{g} + {3 * TRIES})", f"{g} < 1") for g in "xy"}, sql)
    logs = ", ".join(f"coalesce(l_{g}, 0) + ln(d_{g}) + CASE WHEN {g} < 1 THEN ln(w_{g}) / {g} ELSE 0 END AS l_{g}" for g in "xy")
    return f"SELECT * REPLACE ({logs}) FROM ({sql})"


# 300 draws per row, keyed by seed 0, simulation, arm and item; their sums in millionths are whole numbers.
DRAWN = f""", keyed AS (SELECT sim_id, arm, CAST(revenue AS DOUBLE) AS revenue, alpha_post AS x, beta_post AS y,
      md5('0|' || CAST(sim_id AS VARCHAR) || '|' || arm || '|' || CAST(line_item_id AS VARCHAR)) AS h
    FROM ({posterior('aa', 'JOIN')}) WHERE sim_id IS NOT NULL AND revenue <> 0),
  draws AS (SELECT sim_id, arm, revenue, x, y, draw, ('0x' || substr(h, 1, 8))::UBIGINT AS k0, ('0x' || substr(h, 9, 8))::UBIGINT AS k1,
      CAST(draw * {2 * SLOTS} AS UBIGINT) AS c_x, CAST(draw * {2 * SLOTS} + {SLOTS} AS UBIGINT) AS c_y,
      CASE WHEN x < 1 THEN x + 1 ELSE x END - 1::DOUBLE / 3 AS d_x, CASE WHEN y < 1 THEN y + 1 ELSE y END - 1::DOUBLE / 3 AS d_y
    FROM keyed, range(300) r(draw)),
  micro AS (SELECT sim_id, arm, draw,
      CAST(round_even(1 / (1 + exp(least(l_y - l_x, 700::DOUBLE))) * revenue * 1e6::DOUBLE, 0) AS BIGINT) AS m FROM ({gamma_tries('SELECT * FROM draws')})),
  sums AS (SELECT sim_id, draw, CAST(SUM(CASE WHEN arm = 'a1' THEN m END) AS DOUBLE) AS s1, CAST(SUM(CASE WHEN arm = 'a2' THEN m END) AS DOUBLE) AS s2
    FROM micro GROUP BY 1, 2),
  weights AS (SELECT sim_id, SUM(CASE WHEN arm = 'a1' THEN revenue END) AS r1, SUM(CASE WHEN arm = 'a2' THEN revenue END) AS r2 FROM keyed GROUP BY 1),
  wins AS (SELECT s.sim_id, avg(CAST(s2 / r2 > s1 / r1 AS INTEGER)) AS a2_wins FROM sums s JOIN weights w ON w.sim_id = s.sim_id GROUP BY 1),
  drawn AS (SELECT sim_id, CASE WHEN a2_wins > 0.975::DOUBLE OR a2_wins < 0.025::DOUBLE THEN 1 ELSE 0 END AS drawn_positive FROM wins)"""
served = ["served_items"]

SQL = {
    "priors": with_roles(served, POP + prior("pop") + f"SELECT line_item_id, {R('alpha', 'alpha')}, {R('beta', 'beta')} FROM pr"),
    "posteriors": with_roles(
        served,
        items(True) + GOAL + f"SELECT sim_id, line_item_id, {R('post_sla_li', 'post_sla_li', 8)}, {R('rev_sla_li', 'rev_sla_li', 2)}, "
        f"{R('prior_p', 'prior_p', 8)} FROM ({posterior('items')})",
    ),
    "posterior_totals": with_roles(served, SIMS + f"SELECT sim_id, {TOTALS_OUT} FROM sims"),
    "posterior_population": with_roles(
        served, POP + prior("pop") + f", post AS ({posterior('pop')}) SELECT {TOTALS_OUT} FROM ({totals()})"
    ),
    "posterior_summary": with_roles(served, SIMS + f"{summary('pct_rev_sla')} UNION ALL {summary('pct_rev_sla_li')}"),
    "variance_reduction": with_roles(
        served,
        SIMS + f"""SELECT {R('var_samp(pct_rev_sla)', 'raw_var', 8)}, {R('var_samp(pct_rev_sla_li)', 'shrunk_var', 8)},
        {R('(1 - var_samp(pct_rev_sla_li) / var_samp(pct_rev_sla)) * 100', 'variance_reduction_pct', 8)} FROM sims""",
    ),
    "overdispersion": with_roles(
        served,
        POP + f"""SELECT {R(f'avg({C})', 'count_mean', 8)}, {R(f'var_pop({C})', 'count_var', 8)},
        {R(f'var_pop({C}) / avg({C})', 'count_dispersion', 8)}, {R('avg(sla_flag)', 'flag_rate', 8)},
        {R('var_samp(sla_flag) / (avg(sla_flag) * (1 - avg(sla_flag)))', 'binary_dispersion', 8)},
        COUNT({RATIO}) AS rows_with_conversions, {R(f'avg({RATIO})', 'calib_mean', 8)}, {R(f'var_samp({RATIO})', 'calib_var', 8)},
        {R(f'stddev_samp({RATIO})', 'calib_std', 8)}, {R(f'stddev_samp({RATIO}) / avg({RATIO})', 'calib_cv', 8)},
        {R(f'CASE WHEN var_pop({C}) > avg({C}) THEN avg({C})^2 / (var_pop({C}) - avg({C})) END', 'negbin_r', 8)} FROM pop""",
    ),
    "prior_strength": with_roles(
        served,
        POP + f""", p AS (SELECT least(greatest(SUM({W} * sla_flag) / SUM({W}), 1e-6), 1 - 1e-6) AS p_bar,
          corr(sla_flag, {C}) AS correlation FROM pop),
        v AS (SELECT p_bar, correlation, p_bar * (1 - p_bar) AS max_v, SUM({W} * (sla_flag - p_bar)^2) / SUM({W}) AS v_bar
          FROM pop, p GROUP BY 1, 2, 3),
        s AS (SELECT *, v_bar / max_v AS variance_ratio, max_v / v_bar - 1 AS nu_est FROM v)
        SELECT {R('correlation', 'correlation', 8)}, {R('p_bar', 'p_bar', 8)}, {R('v_bar', 'v_bar', 8)}, {R('max_v', 'max_v', 8)},
        {R('variance_ratio', 'variance_ratio', 8)}, {R('nu_est', 'nu_est', 8)}, {R('10 / (10 + nu_est)', 'data_weight_10', 8)},
        {R('100 / (100 + nu_est)', 'data_weight_100', 8)}, {R('nu_est / (10 + nu_est)', 'prior_weight_10', 8)},
        {R('nu_est / (100 + nu_est)', 'prior_weight_100', 8)} FROM s""",
    ),
    "conversion_buckets": with_roles(
        served,
        items(True) + """SELECT CASE WHEN conversions <= 1 THEN '0-1' WHEN conversions <= 10 THEN '1-10' WHEN conversions <= 50 THEN '10-50'
          WHEN conversions <= 100 THEN '50-100' ELSE '100+' END AS conv_bucket, round_even(avg(sla_flag), 4) AS mean_sla,
          round_even(stddev_samp(sla_flag), 4) AS std_sla, COUNT(*) AS n_items FROM items WHERE conversions > 0 GROUP BY 1""",
    ),
    "id_overlap": with_roles(
        ["aa_wide"],
        GOAL + f""", a AS (SELECT DISTINCT line_item_id FROM aa_wide),
        n AS (SELECT (SELECT COUNT(*) FROM a) AS ids, (SELECT COUNT(*) FROM (SELECT line_item_id FROM a INTERSECT SELECT line_item_id FROM pr)) AS overlap)
        SELECT ids, overlap, {R('overlap / ids', 'overlap_ratio')} FROM n""",
    ),
    "aa_frame": with_roles(
        ["aa_wide"],
        AA + f"""SELECT sim_id, line_item_id, arm, {R('conversions', 'conversions')}, {R('conversions_pred', 'conversions_pred')},
        {R('revenue', 'revenue')}, {R('calibration', 'calibration')}, sla_flag, {R('rev_sla', 'rev_sla')} FROM aa""",
    ),
    "aa_normal": with_roles(
        ["aa_wide"],
        AA_NORMAL + "SELECT sim_id, " + ", ".join(R(c, c, 8) for c in ("mu_a1", "mu_a2", "var_a1", "var_a2", "z")) + ", false_positive FROM decided",
    ),
    "aa_beta": with_roles(["aa_wide"], AA_NORMAL + f"SELECT sim_id, 1 AS near_normal, {CLEAR} AS false_positive FROM decided"),
    "aa_beta_verdict": with_roles(
        ["aa_wide"],
        AA_NORMAL + DRAWN + f"""SELECT simulations, least_false_positives, most_false_positives, drawn_within,
        CAST(false_positives AS BIGINT) AS false_positives, {R('false_positives / simulations', 'fp_rate')},
        {', '.join(f"CASE WHEN {c} / simulations <= 0.05 THEN 'SAFE' ELSE 'NOISY' END AS {n}"
                   for c, n in (('false_positives', 'verdict'), ('least_false_positives', 'best_verdict'), ('most_false_positives', 'worst_verdict')))}
        FROM (SELECT COUNT(*) AS simulations, CAST(SUM(least) AS BIGINT) AS least_false_positives, CAST(SUM(most) AS BIGINT) AS most_false_positives,
          MIN(CAST(drawn_positive BETWEEN least AND most AS INTEGER)) AS drawn_within, SUM(drawn_positive) AS false_positives
          FROM (SELECT drawn_positive,
              CASE WHEN abs(z) - 1.959963984540054::DOUBLE > 0.6::DOUBLE THEN 1 ELSE 0 END AS least,
              CASE WHEN abs(z) - 1.959963984540054::DOUBLE < -0.6::DOUBLE THEN 0 ELSE 1 END AS most
            FROM drawn JOIN decided ON decided.sim_id = drawn.sim_id))""",
    ),
    "aa_normal_verdict": with_roles(
        ["aa_wide"],
        AA_NORMAL + f"""SELECT CAST(SUM(false_positive) AS BIGINT) AS false_positives, COUNT(*) AS simulations,
        {R('avg(false_positive)', 'fp_rate')}, CASE WHEN avg(false_positive) <= 0.05 THEN 'SAFE' ELSE 'NOISY' END AS verdict FROM decided""",
    ),
}
