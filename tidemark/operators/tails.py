"""Power-law tails per user, tests against other families, and the family that fits best."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import normal, powerlaw, weibull
from tidemark.functions.lineage import checkpointed
from tidemark.functions.runs import in_runs
from tidemark.operators.fits import _cut, _gamma, _ln_gamma, _weibull
from tidemark.plans.operator import Operator as O
from tidemark.plans.operator import spread

_LN_2PI = "ln(2 * 3.141592653589793E0)"


def _two_sided(z: str) -> str:
    """p of a standard normal beyond |z| on either side, by a rational approximation of erfc."""
    t = f"(1 / (1 + 0.3275911E0 * abs({z}) / sqrt(2.0E0)))"
    return f"{t} * (0.254829592E0 + {t} * (-0.284496736E0 + {t} * (1.421413741E0 + {t} * (-1.453152027E0 + {t} * 1.061405429E0)))) * exp(-({z}) * ({z}) / 2)"



def _user_powerlaw(gaps: DataFrame, k: int = 50, least: int = 10, most_alone: int = 10_000) -> DataFrame:
    """Users of ``most_alone`` values at most in one sorted pass, others by ranges."""
    rows = checkpointed(gaps.select("did", "gap").where("gap > 0 AND did IS NOT NULL"))
    found, rest = in_runs(rows, lambda x, starts: powerlaw.best_of_runs(x, starts, k, least), "xmin double, t double, s double, alpha double, ks double", most_alone)
    if rest is not None:
        counts = checkpointed(powerlaw.value_counts(rest, F.col("gap") / 1e6, ["did"], least))
        found = found.unionByName(powerlaw.best(powerlaw.fits(counts, powerlaw.candidates_by_log(counts, ["did"], k), ["did"], least=2), ["did"]))
    found = found.where("t >= 5")
    log_lik = F.expr("round(t * ln(t / s) - t * ln(xmin) - (1 + t / s) * s, 4)")
    return found.select("did", F.col("t").cast("long").alias("n_tail"), "xmin", F.round("alpha", 6).alias("alpha"), F.round("ks", 6).alias("ks"), log_lik.alias("log_lik"))


def _cut_lognormal(tail: DataFrame, power: DataFrame) -> DataFrame:
    y = F.log(F.col("gap") / 1e6) - F.log("xmin")
    rows = tail.join(power.select("did", "xmin"), "did").select("did", F.log("xmin").alias("a"), y.alias("y"))
    return normal.truncated(rows.groupBy("did", "a").agg(F.avg("y").alias("m1"), (F.avg(F.col("y") * F.col("y")) / F.pow(F.avg("y"), 2)).alias("q")).where("m1 > 1e-9"))


#: The fits of one set of vectors (did, gap): what an operator is told as, its doc, inputs, statement, parameters, work.
_STEPS = (
    ("powerlaw", "Power law of each user's values in seconds: :k log-spaced whole candidates for xmin, the first with the least KS distance; none if its tail has under 5 values.", ("gaps",), """WITH v AS (SELECT did, gap / 1e6 AS x, cast(count(*) AS DOUBLE) AS n FROM {gaps} WHERE gap > 0 GROUP BY did, gap),
      u AS (SELECT did, ln(min(x)) AS lo, ln(max(x)) AS hi FROM v GROUP BY did HAVING sum(n) >= :least),
      c AS (SELECT DISTINCT did, round(exp(lo + i * (hi - lo) / (:k - 1))) AS xmin FROM (SELECT did, lo, hi, $EACH(:k) AS i FROM u) AS e),
      a AS (SELECT c.did, c.xmin, sum(v.n) AS t, sum(v.n * ln(v.x / c.xmin)) AS s FROM c JOIN v ON c.did = v.did AND v.x >= c.xmin WHERE c.xmin > 0 GROUP BY c.did, c.xmin HAVING sum(v.n) >= 2 AND sum(v.n * ln(v.x / c.xmin)) > 1e-9),
      d AS (SELECT a.did, a.xmin, a.t, a.s, abs(sum(v.n) OVER (PARTITION BY a.did, a.xmin ORDER BY v.x) / a.t - (1 - pow(v.x / a.xmin, -a.t / a.s))) AS d FROM a JOIN v ON a.did = v.did AND v.x >= a.xmin),
      k AS (SELECT did, xmin, t, s, max(d) AS ks FROM d GROUP BY did, xmin, t, s),
      r AS (SELECT did, xmin, t, s, ks, row_number() OVER (PARTITION BY did ORDER BY round(ks, 9), xmin) AS place FROM k)
      SELECT did, cast(t AS BIGINT) AS n_tail, xmin, round(1 + t / s, 6) AS alpha, round(ks, 6) AS ks, round(t * ln(t / s) - t * ln(xmin) - (1 + t / s) * s, 4) AS log_lik FROM r WHERE place = 1 AND t >= 5""", {"k": 50, "least": 10}, _user_powerlaw),
    ("tail", "Values that a user's fits use: the power law's tail, or all of them where there is none.", ("gaps", "powerlaw"), """WITH u AS (SELECT did FROM {gaps} WHERE gap > 0 GROUP BY did HAVING count(*) >= :least)
      SELECT g.did, g.gap FROM {gaps} AS g JOIN u ON u.did = g.did LEFT JOIN {powerlaw} AS p ON p.did = g.did WHERE g.gap > 0 AND (p.xmin IS NULL OR g.gap / 1e6 >= p.xmin)""", {"least": 10}, None),
    ("closed", "Exponential and lognormal of each user's tail, in closed form.", ("tail",), "SELECT did, count(*) AS n, round(1e6 / avg(gap), 9) AS rate, round(avg(ln(gap / 1e6)), 6) AS meanlog, round(stddev_pop(ln(gap / 1e6)), 6) AS sdlog FROM {tail} GROUP BY did", {}, None),
    ("gamma", "Gamma fits of tails.", ("tail",), _gamma().replace("{d1_gaps}", "{tail}"), {"least": 5}, None),
    ("weibull", "Weibull fits of tails.", ("tail",), _weibull().replace("{d1_gaps}", "{tail}"), {"least": 5}, lambda tail, least=5: weibull.fits(tail, least)),
    ("lognormal", "Lognormals of tails cut at xmin, by maximum likelihood; none where the power law is its limit.", ("tail", "powerlaw"), normal.truncated_sql("SELECT t.did, ln(p.xmin) AS a, avg(ln(t.gap / 1e6) - ln(p.xmin)) AS m1, avg(pow(ln(t.gap / 1e6) - ln(p.xmin), 2)) / pow(avg(ln(t.gap / 1e6) - ln(p.xmin)), 2) AS q FROM {tail} AS t JOIN {powerlaw} AS p ON p.did = t.did GROUP BY t.did, p.xmin HAVING avg(ln(t.gap / 1e6) - ln(p.xmin)) > 1e-9"), {}, _cut_lognormal),
    ("vuong", "Vuong's tests of each user's power law against an exponential and a lognormal cut at xmin: statistic (above 0: the power law) and two-sided p; 0 and 1 where the power law is the lognormal's limit.", ("tail", "powerlaw", "lognormal"), f"""WITH t AS (SELECT g.did, g.gap / 1e6 AS x, p.alpha, p.xmin FROM {{tail}} AS g JOIN {{powerlaw}} AS p ON p.did = g.did),
      f AS (SELECT did, avg(x) - min(xmin) AS beyond FROM t GROUP BY did HAVING avg(x) - min(xmin) > 1e-9 AND stddev_pop(ln(x)) > 1e-9),
      r AS (SELECT t.did, ln((alpha - 1) / xmin) - alpha * ln(x / xmin) AS pl, -ln(f.beyond) - (x - xmin) / f.beyond AS ex, -ln(x) - ln(sigma) - 0.5E0 * {_LN_2PI} - (ln(x) - mu) * (ln(x) - mu) / (2 * sigma * sigma) - ln_q AS lg FROM t JOIN f ON f.did = t.did LEFT JOIN {{lognormal}} AS l ON l.did = t.did),
      z AS (SELECT did, count(*) AS n, sqrt(cast(count(*) AS DOUBLE)) * avg(pl - ex) / nullif(stddev_samp(pl - ex), 0) AS ze, coalesce(sqrt(cast(count(*) AS DOUBLE)) * avg(pl - lg) / nullif(stddev_samp(pl - lg), 0), 0.0E0) AS zl FROM r GROUP BY did)
      SELECT did, n, round(ze, 4) AS r_exponential, round({_two_sided("ze")}, 5) AS p_exponential, round(zl, 4) AS r_lognormal, round({_two_sided("zl")}, 5) AS p_lognormal FROM z""", {}, None),
    ("fits", "All fits of each user's values with AIC, and the best family: the power law if it beats both alternatives at 0.05, else the first that beats it, else the least AIC.", ("tail", "powerlaw", "closed", "gamma", "weibull", "vuong"), f"""WITH s AS (SELECT t.did, sum(pow(t.gap / 1e6 / w.scale, w.shape)) AS wsum FROM {{tail}} AS t JOIN {{weibull}} AS w ON w.did = t.did GROUP BY t.did),
      a AS (SELECT c.did, c.n, c.rate, c.meanlog, c.sdlog, p.alpha, p.xmin, p.ks, g.shape AS gk, g.rate AS gr, w.shape AS wk, w.scale AS ws, v.r_exponential, v.p_exponential, v.r_lognormal, v.p_lognormal,
        round(4 - 2 * p.log_lik, 2) AS powerlaw, round(2 - 2 * c.n * (ln(c.rate) - 1), 2) AS exponential, CASE WHEN c.sdlog > 0 THEN round(4 - 2 * c.n * (-c.meanlog - ln(c.sdlog) - 0.5E0 * {_LN_2PI} - 0.5E0), 2) END AS lognormal,
        round(4 - 2 * (c.n * (ln(w.shape) - w.shape * ln(w.scale) + (w.shape - 1) * c.meanlog) - s.wsum), 1) AS weibull, round(4 - 2 * c.n * (g.shape * ln(g.rate) - ({_ln_gamma("g.shape")}) + (g.shape - 1) * c.meanlog - g.rate / c.rate), 1) AS gamma
        FROM {{closed}} AS c LEFT JOIN {{powerlaw}} AS p ON p.did = c.did LEFT JOIN {{gamma}} AS g ON g.did = c.did LEFT JOIN {{weibull}} AS w ON w.did = c.did LEFT JOIN s ON s.did = c.did LEFT JOIN {{vuong}} AS v ON v.did = c.did)
      SELECT did, n, alpha, xmin, ks, rate, meanlog, sdlog, gk AS gamma_shape, gr AS gamma_rate, wk AS weibull_shape, ws AS weibull_scale, r_exponential, p_exponential, r_lognormal, p_lognormal,
        powerlaw AS aic_powerlaw, exponential AS aic_exponential, lognormal AS aic_lognormal, weibull AS aic_weibull, gamma AS aic_gamma,
        CASE WHEN r_exponential > 0 AND p_exponential < 0.05E0 AND r_lognormal > 0 AND p_lognormal < 0.05E0 THEN 'powerlaw' WHEN r_exponential < 0 AND p_exponential < 0.05E0 THEN 'exponential' WHEN r_lognormal < 0 AND p_lognormal < 0.05E0 THEN 'lognormal'
          ELSE CASE least(powerlaw, exponential, lognormal, weibull, gamma) WHEN powerlaw THEN 'powerlaw' WHEN exponential THEN 'exponential' WHEN lognormal THEN 'lognormal' WHEN weibull THEN 'weibull' ELSE 'gamma' END END AS best FROM a""", {}, None),
)


def _fits(gaps: str, names: dict[str, str]) -> list[O]:
    """The operators of _STEPS on the vectors of that input, under those names; each is read by several others, so its rows are kept."""
    names = {"gaps": gaps, **names}
    out = []
    for role, doc, inputs, sql, params, work in _STEPS:
        for part in inputs:
            sql = sql.replace(f"{{{part}}}", f"{{{names[part]}}}")
        out.append(_cut(O(names[role], doc, tuple(names[x] for x in inputs), sql, params, work)))
    return out


_PARAMS = (("powerlaw", "alpha"), ("powerlaw", "xmin"), ("exponential", "rate"), ("lognormal", "meanlog"), ("lognormal", "sdlog"), ("weibull", "weibull_shape"), ("weibull", "weibull_scale"), ("gamma", "gamma_shape"), ("gamma", "gamma_rate"))
_WHICH = lambda values: "CASE i " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_LONG = f"SELECT source, quantity, {_WHICH([chr(39) + f + chr(39) for f, _ in _PARAMS])} AS family, {_WHICH([chr(39) + c + chr(39) for _, c in _PARAMS])} AS param, cast({_WHICH([c for _, c in _PARAMS])} AS DOUBLE) AS value, best FROM (SELECT *, $EACH({len(_PARAMS)}) AS i FROM {{g11_fit_sessions}}) AS e"
_KEYS = ("source", "quantity", "family", "param")

OPERATORS = (
    *_fits("d1_gaps", {"powerlaw": "g6_user_powerlaw", "tail": "g7_tail", "closed": "g7_closed_form_fits", "gamma": "g8_tail_gamma", "weibull": "g8_tail_weibull", "lognormal": "g9_cut_lognormal", "vuong": "g9_vuong", "fits": "g11_fit_gaps"}),
    O("g15_export_params", "Parameters of each user's best family within the windows that reports keep: alpha 1 to 10, xmin 0.001 to 24 hours, sdlog up to 10, shape 0.01 to 5.", ("g11_fit_gaps",), """SELECT did, best, CASE best WHEN 'powerlaw' THEN alpha WHEN 'exponential' THEN rate WHEN 'lognormal' THEN meanlog WHEN 'weibull' THEN weibull_shape ELSE gamma_shape END AS first_param,
      CASE best WHEN 'powerlaw' THEN xmin WHEN 'lognormal' THEN sdlog WHEN 'weibull' THEN weibull_scale WHEN 'gamma' THEN gamma_rate END AS second_param FROM {g11_fit_gaps}
      WHERE best = 'exponential' OR best = 'powerlaw' AND alpha BETWEEN 1 AND 10 AND xmin / 3600 BETWEEN 0.001E0 AND 24 OR best = 'lognormal' AND sdlog BETWEEN 0 AND 10 OR best = 'weibull' AND weibull_shape BETWEEN 0.01E0 AND 5 OR best = 'gamma' AND gamma_shape BETWEEN 0.01E0 AND 5"""),
    O("g15_pareto_params", "Power-law parameters of the users they fit best.", ("g11_fit_gaps",), "SELECT did, 'gap' AS quantity, 'd1_gaps' AS source, alpha, xmin FROM {g11_fit_gaps} WHERE best = 'powerlaw' AND alpha IS NOT NULL AND xmin IS NOT NULL"),
    _cut(O("g11_vectors", "Durations and gaps to the next session over nought, in microseconds, of sessions of all events, of all but likes, and of those cut at six hours; did tells source, quantity and user.", ("d4_sessions_rich", "d4_sessions_engaged", "d5_wide_sessions"), """WITH s AS (SELECT 'all' AS source, did, session_end - session_start AS d, next_session_start - session_end AS g FROM {d4_sessions_rich} UNION ALL SELECT 'engaged', did, session_end - session_start, next_session_start - session_end FROM {d4_sessions_engaged} UNION ALL SELECT 'six_hours', did, session_end - session_start, next_session_start - session_end FROM {d5_wide_sessions}),
      e AS (SELECT source, did, d, g, $EACH(2) AS i FROM s)
      SELECT concat(source, CASE i WHEN 0 THEN '|duration|' ELSE '|gap|' END, did) AS did, CASE i WHEN 0 THEN d ELSE g END AS gap FROM e WHERE CASE i WHEN 0 THEN d ELSE g END > 0""")),
    *_fits("g11_vectors", {role: f"g11_sessions_{role}" for role in ("powerlaw", "tail", "closed", "gamma", "weibull", "lognormal", "vuong", "fits")}),
    O("g11_fit_sessions", "All fits of session durations and gaps by source, quantity and user.", ("g11_sessions_fits", "g11_sessions_powerlaw"), """SELECT split_part(f.did, '|', 1) AS source, split_part(f.did, '|', 2) AS quantity, regexp_replace(f.did, '^[^|]*[|][^|]*[|]', '') AS did, f.n, p.n_tail, f.alpha, f.xmin, f.ks, f.rate, f.meanlog, f.sdlog, f.gamma_shape, f.gamma_rate, f.weibull_shape, f.weibull_scale,
      f.r_exponential, f.p_exponential, f.r_lognormal, f.p_lognormal, f.aic_powerlaw, f.aic_exponential, f.aic_lognormal, f.aic_weibull, f.aic_gamma, f.best FROM {g11_sessions_fits} AS f LEFT JOIN {g11_sessions_powerlaw} AS p ON p.did = f.did"""),
    O("g12_best_fit_sessions", "Users by best family, for each source and quantity.", ("g11_fit_sessions",), "SELECT source, quantity, best, count(*) AS users, round(100.0E0 * count(*) / sum(count(*)) OVER (PARTITION BY source, quantity), 6) AS pct FROM {g11_fit_sessions} GROUP BY source, quantity, best"),
    spread("g13_param_stats_sessions", "Parameters of the users that a family fits best, for each source and quantity.", ("g11_fit_sessions",), f"SELECT * FROM ({_LONG}) AS l WHERE best = family AND value IS NOT NULL", _KEYS,
      {"users": "count(*)", "mean": "round(avg(value), 4)", "sd": "round(stddev_samp(value), 4)", "under_1": "round(avg(CASE WHEN value < 1 THEN 1.0E0 ELSE 0.0E0 END), 6)", "mean_inverse": "round(avg(1 / nullif(value, 0)), 3)"}, {"median": ("value", 0.5, 6)}),
    O("g13_param_summary_sessions", "The same with what each family is read by: the share of Weibull shapes under 1, the mean wait of exponentials, the median of lognormals.", ("g13_param_stats_sessions",), """SELECT source, quantity, family, param, users, mean, sd, median, CASE WHEN param = 'weibull_shape' THEN under_1 WHEN param = 'rate' THEN mean_inverse WHEN param = 'meanlog' THEN round(exp(median), 4) END AS extra FROM {g13_param_stats_sessions}"""),
    spread("g14_param_percentiles_sessions", "Percentiles of every family's parameters over all users fitted, for each source and quantity.", ("g11_fit_sessions",), f"SELECT * FROM ({_LONG}) AS l WHERE value IS NOT NULL", _KEYS, {"users": "count(*)"}, {f"p{p}": ("value", p / 100, 6) for p in (1, 5, 25, 50, 75, 95, 99)}),
    O("g14_param_correlations_sessions", "Correlation of the logarithms of each family's two parameters, of the lognormal's as they are, for each source and quantity.", ("g11_fit_sessions",), """SELECT source, quantity, CASE i WHEN 0 THEN 'powerlaw' WHEN 1 THEN 'lognormal' WHEN 2 THEN 'weibull' ELSE 'gamma' END AS family, count(*) AS users, round(corr(x, y), 4) AS r FROM (SELECT source, quantity, i, CASE i WHEN 0 THEN ln(nullif(alpha, 0)) WHEN 1 THEN meanlog WHEN 2 THEN ln(nullif(weibull_shape, 0)) ELSE ln(nullif(gamma_shape, 0)) END AS x,
        CASE i WHEN 0 THEN ln(nullif(xmin, 0)) WHEN 1 THEN sdlog WHEN 2 THEN ln(nullif(weibull_scale, 0)) ELSE ln(nullif(gamma_rate, 0)) END AS y FROM (SELECT *, $EACH(4) AS i FROM {g11_fit_sessions}) AS e) AS p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY source, quantity, i HAVING count(*) >= 2"""),
    O("g15_export_sessions", "The fits within the windows that reports keep, one row for each source, quantity and user.", ("g11_fit_sessions",), """SELECT * FROM {g11_fit_sessions} WHERE best = 'exponential' OR best = 'powerlaw' AND alpha BETWEEN 1 AND 10 AND xmin / 3600 BETWEEN 0.001E0 AND 24 OR best = 'lognormal' AND sdlog BETWEEN 0 AND 10
      OR best = 'weibull' AND weibull_shape BETWEEN 0.01E0 AND 5 OR best = 'gamma' AND gamma_shape BETWEEN 0.01E0 AND 5"""),
)
