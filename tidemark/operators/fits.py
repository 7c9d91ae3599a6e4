"""Knees of histograms, automated users, and fits of distributions."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import normal, powerlaw, weibull
from tidemark.functions.lineage import checkpointed
from tidemark.functions.ranks import running
from tidemark.operators import activity
from tidemark.plans.operator import Operator as O
from tidemark.plans.operator import spread


def _cut(op: O) -> O:
    """op, its rows checkpointed in Spark: many later steps read them, and its expressions stay out of theirs."""
    return replace(op, work=lambda *frames, **params: checkpointed(op(*frames, **params)))


def _knee(y: str) -> str:
    """CTEs from grid (i, y), rows without gaps in i: knee holds the i of the first knee, if any. y: the curve's height, rising and concave, from y0 (0 to 1)."""
    return f"""unit AS (SELECT i, cast(i - min(i) OVER () AS DOUBLE) / nullif(max(i) OVER () - min(i) OVER (), 0) AS x, cast(y - min(y) OVER () AS DOUBLE) / nullif(max(y) OVER () - min(y) OVER (), 0) AS y0, count(*) OVER () AS m FROM grid),
      off AS (SELECT i, m, {y} - x AS d FROM unit),
      near AS (SELECT i, m, d, coalesce(lag(d) OVER (ORDER BY i), d) AS a, coalesce(lead(d) OVER (ORDER BY i), d) AS b, lead(d) OVER (ORDER BY i) AS after FROM off),
      marks AS (SELECT i, d, after, max(CASE WHEN d >= a AND d >= b THEN i END) OVER w AS top, max(CASE WHEN d <= a AND d <= b THEN i END) OVER w AS low FROM near WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      knee AS (SELECT min(top) AS i FROM (SELECT k.i, k.top FROM marks AS k JOIN near AS t ON t.i = k.top WHERE k.after < CASE WHEN k.low >= k.top THEN 0.0E0 ELSE t.d - 1.0E0 / (t.m - 1) END ORDER BY k.i LIMIT 1) AS f)"""


_TAILS = """a AS (SELECT xmin, sum(n) AS t, 1 + sum(n) / sum(n * ln(x / (xmin - 0.5E0))) AS alpha FROM c JOIN v ON x >= xmin GROUP BY xmin HAVING sum(n) >= 10),
      d AS (SELECT xmin, t, alpha, abs(sum(n) OVER (PARTITION BY xmin ORDER BY x) / t - (1 - pow((x + 0.5E0) / (xmin - 0.5E0), 1 - alpha))) AS d FROM a JOIN v ON x >= xmin)"""


def _digamma(x: str) -> str:
    """Digamma: six steps up, then the asymptotic series."""
    z = f"({x} + 6)"
    return f"(ln({z}) - 0.5E0 / {z} - 1 / (12 * pow({z}, 2)) + 1 / (120 * pow({z}, 4)) - 1 / (252 * pow({z}, 6)) - " + " - ".join(f"1 / ({x} + {k}.0E0)" for k in range(6)) + ")"


def _trigamma(x: str) -> str:
    z = f"({x} + 6)"
    return f"(1 / {z} + 0.5E0 / pow({z}, 2) + 1 / (6 * pow({z}, 3)) - 1 / (30 * pow({z}, 5)) + 1 / (42 * pow({z}, 7)) + " + " + ".join(f"1 / pow({x} + {k}.0E0, 2)" for k in range(6)) + ")"


def _ln_gamma(x: str) -> str:
    """Log gamma: six steps up, then Stirling's series."""
    z = f"({x} + 6)"
    return f"({z} - 0.5E0) * ln({z}) - {z} + 0.5E0 * ln(2 * 3.141592653589793E0) + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) - " + " - ".join(f"ln({x} + {k}.0E0)" for k in range(6))


def _gamma(steps: int = 4) -> str:
    ctes = ["k0 AS (SELECT did, n, mean, s, (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS k FROM (SELECT did, count(*) AS n, avg(x) AS mean, ln(avg(x)) - avg(ln(x)) AS s FROM v GROUP BY did HAVING count(*) >= :least) AS q WHERE s > 1e-9)"]
    ctes += [f"k{i} AS (SELECT did, n, mean, s, greatest(k - (ln(k) - {_digamma('k')} - s) / (1 / k - {_trigamma('k')}), 1e-6) AS k FROM k{i - 1})" for i in range(1, steps + 1)]
    return f"WITH v AS (SELECT did, gap / 1e6 AS x FROM {{d1_gaps}} WHERE gap > 0), {', '.join(ctes)} SELECT did, n, round(k, 6) AS shape, round(k / mean, 9) AS rate FROM k{steps}"


def _weibull(steps: int = 7) -> str:
    """The statement of ``weibull.fits``: Newton's steps on the shape, each one aggregation of partial sums per user; values are taken over the user's mean."""
    ctes = [
        "m AS (SELECT did, count(*) AS n, avg(x) AS mean FROM g GROUP BY did HAVING count(*) >= :least)",
        "v AS (SELECT g.did, m.n, m.mean, ln(g.x / m.mean) AS l FROM g JOIN m ON g.did = m.did)",
        "w0 AS (SELECT did, n, mean, avg(l) AS lm, 1.2E0 / stddev_pop(l) AS k, 0.0E0 AS z FROM v GROUP BY did, n, mean HAVING stddev_pop(l) > 1e-9)",
    ]
    for i in range(1, steps + 1):
        sums = f"SELECT w.did, w.n, w.mean, w.lm, w.k, sum(exp(w.k * l)) AS s0, sum(exp(w.k * l) * l) AS s1, sum(exp(w.k * l) * l * l) AS s2 FROM v JOIN w{i - 1} AS w ON v.did = w.did GROUP BY w.did, w.n, w.mean, w.lm, w.k"
        step = "(s1 / s0 - 1 / k - lm) / (s2 / s0 - (s1 / s0) * (s1 / s0) + 1 / (k * k))"
        ctes.append(f"w{i} AS (SELECT did, n, mean, lm, greatest(k - {step}, k / 4) AS k, s0 AS z FROM ({sums}) AS q)")
    last = f"SELECT w.did, w.n, w.mean, w.k, avg(exp(w.k * l)) AS p FROM v JOIN w{steps} AS w ON v.did = w.did GROUP BY w.did, w.n, w.mean, w.k"
    return f"WITH g AS (SELECT did, gap / 1e6 AS x FROM {{d1_gaps}} WHERE gap > 0), {', '.join(ctes)} SELECT did, n, round(k, 5) AS shape, round(mean * pow(p, 1 / k), 4) AS scale FROM ({last}) AS f"


def _discrete(values: DataFrame, k: int = 80) -> DataFrame:
    counts = checkpointed(powerlaw.value_counts(values, F.col("x")))
    found = powerlaw.best(powerlaw.fits(counts, powerlaw.candidates_by_log(counts, (), k), shift=0.5))
    return found.select("xmin", F.round("alpha", 6).alias("alpha"), F.round("ks", 6).alias("ks"), F.col("t").cast("long").alias("n_tail"))


def _bootstrap(draws: DataFrame, fit: DataFrame, k: int = 80) -> DataFrame:
    counts = checkpointed(draws)
    found = powerlaw.best(powerlaw.fits(counts, powerlaw.candidates_by_log(counts, ["r"], k), ["r"], shift=0.5), ["r"])
    both = found.select(F.col("ks").alias("b")).crossJoin(F.broadcast(fit.select("ks")))  # fit is one row
    return both.agg(F.count("*").alias("rounds"), F.max("ks").alias("ks"), F.round(F.avg("b"), 6).alias("mean_ks"), F.avg(F.when(F.col("b") >= F.col("ks"), 1.0).otherwise(0.0)).alias("p"))


def _ranks(lifetimes: DataFrame) -> DataFrame:
    counts = lifetimes.groupBy((F.col("gap") / 1e6).alias("x")).agg(F.count("*").alias("n"))
    return running(counts, [F.col("x")], {"c": F.col("n")}).withColumnRenamed("c_of", "total")


_SMOOTH = 7


def _smoothed() -> str:
    """CTEs that make of raw (i, y) grid (i, y), its least-squares polynomial of degree 7, by polynomials that are orthogonal on an even grid of m places."""
    out = "p0 AS (SELECT i, cast(y AS DOUBLE) AS y, m, (2 * (i - first) - m + 1.0E0) / m AS u FROM (SELECT i, y, min(i) OVER () AS first, count(*) OVER () AS m FROM raw) AS q), p1 AS (SELECT *, 1.0E0 AS t0, u AS t1 FROM p0)"
    for k in range(1, _SMOOTH):
        out += f", p{k + 1} AS (SELECT *, ({2 * k + 1} * u * t{k} - {k} * (1 - {k * k}.0E0 / (m * m)) * t{k - 1}) / {k + 1} AS t{k + 1} FROM p{k})"
    parts = ", ".join(f"CASE WHEN max(m) > {k} THEN sum(y * t{k}) / nullif(sum(t{k} * t{k}), 0) ELSE 0.0E0 END AS a{k}" for k in range(_SMOOTH + 1))
    return out + f", fit AS (SELECT {parts} FROM p{_SMOOTH}), grid AS (SELECT i, {' + '.join(f'a{k} * t{k}' for k in range(_SMOOTH + 1))} AS y FROM p{_SMOOTH} CROSS JOIN fit)"


_BINS = """WITH s AS (SELECT count(*) AS n, max(entropy_bits) AS most, cast(least(200, floor(count(*) / 10)) AS INT) - 1 AS bins FROM {f1_gap_entropy}),
      c AS (SELECT cast(least(floor(entropy_bits * (SELECT bins FROM s) / (SELECT most FROM s)), (SELECT bins FROM s) - 1) AS INT) AS b, count(*) AS y FROM {f1_gap_entropy} WHERE (SELECT bins FROM s) >= 1 AND (SELECT most FROM s) > 0 GROUP BY 1)
      SELECT g.i, coalesce(c.y, 0) AS y, s.most / s.bins AS wide FROM (SELECT $EACH(200) AS i) AS g CROSS JOIN s LEFT JOIN c ON g.i = c.b WHERE g.i >= (SELECT min(b) FROM c) AND g.i < s.bins"""

OPERATORS = (
    O("d23_gap_elbow", "The knee of the falling histogram of a user's gaps by minutes, up to :bins; null if there is none.", ("d1_gaps",), f"""WITH c AS (SELECT cast(floor(gap / 60000000) AS INT) AS b, count(*) AS y FROM {{d1_gaps}} WHERE gap >= 0 AND gap / 60000000 < :bins GROUP BY 1),
      grid AS (SELECT g.i, coalesce(c.y, 0) AS y FROM (SELECT $EACH(:bins) AS i) AS g LEFT JOIN c ON g.i = c.b), {_knee("1 - y0")}
      SELECT (i + 0.5E0) * 60 AS elbow_s FROM knee""", {"bins": 120}),
    _cut(O("f3_bins", "Histogram of entropies from the first bin that isn't empty: 200 bins at most, one for ten users at least.", ("f1_gap_entropy",), _BINS)),
    O("f3_knee", "Knee of the histogram, a rising concave curve; null if there is none.", ("f3_bins",), f"WITH grid AS (SELECT i, y FROM {{f3_bins}}), {_knee('y0')} SELECT i FROM knee"),
    O("f3_smooth_knee", "The same of the histogram's polynomial of degree seven.", ("f3_bins",), f"WITH raw AS (SELECT i, y FROM {{f3_bins}}), {_smoothed()}, {_knee('y0')} SELECT i FROM knee"),
    O("f3_automation_threshold", "Entropy under which users count as automated: the knee of a histogram, else that of its polynomial, else 1; and their share.", ("f1_gap_entropy", "f3_bins", "f3_knee", "f3_smooth_knee"), """WITH b AS (SELECT count(*) AS m, min(i) AS first, max(wide) AS wide FROM {f3_bins}),
      t AS (SELECT CASE WHEN m = 0 THEN 1.0E0 WHEN m < 5 THEN (first + 0.5E0) * wide ELSE coalesce((coalesce(k.i, q.i) + 0.5E0) * wide, 1.0E0) END AS threshold FROM b CROSS JOIN {f3_knee} AS k CROSS JOIN {f3_smooth_knee} AS q)
      SELECT round(max(threshold), 6) AS threshold, count(*) AS users, count(CASE WHEN entropy_bits < threshold THEN 1 END) AS automated, round(100.0E0 * count(CASE WHEN entropy_bits < threshold THEN 1 END) / count(*), 6) AS pct FROM {f1_gap_entropy} CROSS JOIN t"""),
    O("f3_flag_automated", "Users with entropy under the threshold.", ("f1_gap_entropy", "f3_automation_threshold"), "SELECT did, entropy_bits, entropy_bits < (SELECT threshold FROM {f3_automation_threshold}) AS automated FROM {f1_gap_entropy}"),
    O("g2_powerlaw_discrete", "Discrete power law: :k log-spaced candidates for xmin, least KS distance wins.", ("order_counts",), f"""WITH v AS (SELECT cast(x AS DOUBLE) AS x, cast(count(*) AS DOUBLE) AS n FROM {{order_counts}} GROUP BY x),
      c AS (SELECT DISTINCT round(exp((SELECT ln(min(x)) FROM v) + i * ((SELECT ln(max(x)) FROM v) - (SELECT ln(min(x)) FROM v)) / (:k - 1))) AS xmin FROM (SELECT $EACH(:k) AS i) AS g), {_TAILS}
      SELECT xmin, round(alpha, 6) AS alpha, round(max(d), 6) AS ks, cast(t AS BIGINT) AS n_tail FROM d GROUP BY xmin, alpha, t ORDER BY round(max(d), 9), xmin LIMIT 1""", {"k": 80}, _discrete),
    O("g2_draws", "Draws of :rounds replicates of the fitted power law, as many in each as its tail has, :most at most.", ("g2_powerlaw_discrete",), """WITH f AS (SELECT xmin, alpha, least(n_tail, :most) AS m FROM {g2_powerlaw_discrete}), r AS (SELECT xmin, alpha, m, $EACH(:rounds) AS r FROM f),
      i AS (SELECT xmin, alpha, r, $EACH(m) AS i FROM (SELECT /*+ REPARTITION(r) */ * FROM r) AS q), u AS (SELECT xmin, alpha, r, $UNIFORM(':seed:' || r || ':' || i) AS u FROM i)
      SELECT r, cast(least(floor((xmin - 0.5E0) * pow(1 - u, -1 / (alpha - 1)) + 0.5E0), 1e15) AS DOUBLE) AS x, count(*) AS n FROM u GROUP BY 1, 2""", {"rounds": 50, "most": 20000, "seed": 42}),
    O("g2_bootstrap", "Share of replicates, each fitted anew, whose KS distance is no less than that of the values: p of the power law.", ("g2_draws", "g2_powerlaw_discrete"), """WITH v AS (SELECT r, x, cast(n AS DOUBLE) AS n FROM {g2_draws}), e AS (SELECT r, ln(min(x)) AS lo, ln(max(x)) AS hi FROM v GROUP BY r),
      c AS (SELECT DISTINCT r, round(exp(lo + i * (hi - lo) / (:k - 1))) AS xmin FROM (SELECT r, lo, hi, $EACH(:k) AS i FROM e) AS g),
      a AS (SELECT c.r, xmin, sum(n) AS t, 1 + sum(n) / sum(n * ln(x / (xmin - 0.5E0))) AS alpha FROM c JOIN v ON v.r = c.r AND x >= xmin GROUP BY c.r, xmin HAVING sum(n) >= 10),
      d AS (SELECT a.r, xmin, abs(sum(n) OVER (PARTITION BY a.r, xmin ORDER BY x) / t - (1 - pow((x + 0.5E0) / (xmin - 0.5E0), 1 - alpha))) AS d FROM a JOIN v ON v.r = a.r AND x >= xmin),
      b AS (SELECT r, min(ks) AS ks FROM (SELECT r, xmin, max(d) AS ks FROM d GROUP BY r, xmin) AS q GROUP BY r)
      SELECT count(*) AS rounds, max(f.ks) AS ks, round(avg(b.ks), 6) AS mean_ks, avg(CASE WHEN b.ks >= f.ks THEN 1.0E0 ELSE 0.0E0 END) AS p FROM b CROSS JOIN {g2_powerlaw_discrete} AS f""", {"k": 80}, _bootstrap),
    O("g5_lognormal_from_1", "Lognormal of the values from 1, cut there, by maximum likelihood; none if the power law is its limit.", ("order_counts",), normal.truncated_sql("SELECT 'all' AS did, 0.0E0 AS a, avg(ln(x)) AS m1, avg(ln(x) * ln(x)) / pow(avg(ln(x)), 2) AS q FROM {order_counts} WHERE x >= 1 HAVING avg(ln(x)) > 1e-9"), {},
      lambda values: normal.truncated(values.where("x >= 1").select(F.lit("all").alias("did"), F.lit(0.0).alias("a"), F.log("x").alias("y")).groupBy("did", "a").agg(F.avg("y").alias("m1"), (F.avg(F.col("y") * F.col("y")) / F.pow(F.avg("y"), 2)).alias("q")).where("m1 > 1e-9"))),
    O("g5_powerlaw_vs_lognormal", "Log-likelihood ratio of a power law from 1 and a lognormal cut there, both by maximum likelihood, with a two-sided p; undecided where the one is the other's limit.", ("order_counts", "g5_lognormal_from_1"), """WITH f AS (SELECT count(*) AS n, 1 + count(*) / sum(ln(x)) AS alpha FROM {order_counts} WHERE x >= 1),
      b AS (SELECT v.x, f.alpha, l.mu, l.sigma AS sd, l.ln_q FROM {order_counts} AS v CROSS JOIN f LEFT JOIN {g5_lognormal_from_1} AS l ON l.did = 'all' WHERE v.x >= 1),
      r AS (SELECT coalesce(ln(alpha - 1) - alpha * ln(x) - (-ln(x) - ln(sd) - 0.5E0 * ln(2 * 3.141592653589793E0) - (ln(x) - mu) * (ln(x) - mu) / (2 * sd * sd) - ln_q), 0.0E0) AS ratio FROM b),
      z AS (SELECT count(*) AS n, sum(ratio) AS total, coalesce(abs(sum(ratio)) / sqrt(2.0E0 * count(*)) / nullif(stddev_pop(ratio), 0), 0.0E0) AS u FROM r),
      q AS (SELECT n, total, u, 1 / (1 + 0.3275911E0 * u) AS t FROM z),
      p AS (SELECT n, total, t * (0.254829592E0 + t * (-0.284496736E0 + t * (1.421413741E0 + t * (-1.453152027E0 + t * 1.061405429E0)))) * exp(-u * u) AS p FROM q)
      SELECT n, round(total, 4) AS log_ratio, round(p, 6) AS p, CASE WHEN p >= 0.05E0 THEN 'undecided' WHEN total > 0 THEN 'powerlaw' ELSE 'lognormal' END AS winner FROM p"""),
    O("g8_gamma_fits", "Gamma fits per user: shape by Newton's steps from the mean and the mean logarithm.", ("d1_gaps",), _gamma(), {"least": 10}),
    _cut(O("g8_weibull_fits", "Weibull fits per user.", ("d1_gaps",), _weibull(), {"least": 10}, lambda gaps, least=10: weibull.fits(checkpointed(gaps.select("did", "gap")), least))),
    O("g10_least_aic", "The family with the least AIC of exponential, lognormal, gamma and Weibull, per user.", ("d1_gaps", "g8_gamma_fits", "g8_weibull_fits"), f"""WITH v AS (SELECT did, gap / 1e6 AS x FROM {{d1_gaps}} WHERE gap > 0),
      s AS (SELECT v.did, count(*) AS n, avg(x) AS mean, avg(ln(x)) AS lm, stddev_pop(ln(x)) AS sd, min(g.shape) AS gk, min(g.rate) AS gr, min(w.shape) AS wk, min(w.scale) AS ws, sum(pow(x / w.scale, w.shape)) AS wsum FROM v JOIN {{g8_gamma_fits}} AS g ON v.did = g.did JOIN {{g8_weibull_fits}} AS w ON v.did = w.did GROUP BY v.did),
      a AS (SELECT did, n, 2 - 2 * n * (-ln(mean) - 1) AS exponential, 4 - 2 * n * (-lm - ln(sd) - 0.5E0 * ln(2 * 3.141592653589793E0) - 0.5E0) AS lognormal,
        4 - 2 * n * (gk * ln(gr) - ({_ln_gamma('gk')}) + (gk - 1) * lm - gr * mean) AS gamma, 4 - 2 * (n * (ln(wk) - wk * ln(ws) + (wk - 1) * lm) - wsum) AS weibull FROM s)
      SELECT did, n, round(exponential, 2) AS aic_exponential, round(lognormal, 2) AS aic_lognormal, round(gamma, 2) AS aic_gamma, round(weibull, 2) AS aic_weibull,
        CASE least(exponential, lognormal, gamma, weibull) WHEN exponential THEN 'exponential' WHEN lognormal THEN 'lognormal' WHEN gamma THEN 'gamma' ELSE 'weibull' END AS best FROM a"""),
)

OPERATORS += (
    O("g12_best_fit_breakdown", "Users by best family.", ("g11_fit_gaps",), "SELECT best, count(*) AS users, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {g11_fit_gaps} GROUP BY best"),
    O("g13_param_summary", "Parameters of users by best family: mean, median and deviation; for Weibull the share of shapes under 1, for the exponential the mean wait, for the lognormal the median's median.", ("g11_fit_gaps",), " UNION ALL ".join(f"SELECT '{f}' AS best, '{c}' AS param, count({c}) AS users, round(avg({c}), 4) AS mean, round($P({c}, 0.5), 6) AS median, round(stddev_samp({c}), 4) AS sd, {extra} AS extra FROM {{g11_fit_gaps}} WHERE best = '{f}'"
      for f, c, extra in (("powerlaw", "alpha", "CAST(NULL AS DOUBLE)"), ("powerlaw", "xmin", "CAST(NULL AS DOUBLE)"), ("exponential", "rate", "round(avg(1 / nullif(rate, 0)), 3)"), ("lognormal", "meanlog", "round(exp($P(meanlog, 0.5)), 4)"), ("lognormal", "sdlog", "CAST(NULL AS DOUBLE)"),
        ("weibull", "weibull_shape", "round(avg(CASE WHEN weibull_shape < 1 THEN 1.0E0 ELSE 0.0E0 END), 6)"), ("weibull", "weibull_scale", "CAST(NULL AS DOUBLE)"), ("gamma", "gamma_shape", "CAST(NULL AS DOUBLE)"), ("gamma", "gamma_rate", "CAST(NULL AS DOUBLE)")))),
    O("g4_lognormal_curve", "Density and distribution of the fitted lognormal at each distinct value, next to the shares of values.", ("c18_ecdf", "g3_lognormal_fit"), """WITH z AS (SELECT e.x, e.ecdf, f.sigma, (ln(cast(e.x AS DOUBLE)) - f.mu) / f.sigma AS z FROM {c18_ecdf} AS e CROSS JOIN {g3_lognormal_fit} AS f WHERE e.x > 0 AND f.sigma > 0),
      t AS (SELECT *, 1 / (1 + 0.3275911E0 * abs(z) / sqrt(2.0E0)) AS t FROM z), p AS (SELECT *, t * (0.254829592E0 + t * (-0.284496736E0 + t * (1.421413741E0 + t * (-1.453152027E0 + t * 1.061405429E0)))) * exp(-z * z / 2) / 2 AS tail FROM t)
      SELECT x, round(ecdf, 6) AS ecdf, round(CASE WHEN z > 0 THEN 1 - tail ELSE tail END, 5) AS cdf, round(exp(-z * z / 2) / (x * sigma * 2.5066282746310002E0), 6) AS pdf FROM p"""),
    O("g4_lognormal_grid", "Distribution and density of the fitted lognormal on :grid places evenly spaced by logarithm from the least value to the greatest, next to the share of values up to each.", ("order_counts", "g3_lognormal_fit"), """WITH m AS (SELECT ln(cast(min(x) AS DOUBLE)) AS lo, ln(cast(max(x) AS DOUBLE)) AS hi, count(*) AS total FROM {order_counts} WHERE x > 0),
      g AS (SELECT i, lo, hi, total, lo + i * (hi - lo) / (:grid - 1) AS l FROM (SELECT lo, hi, total, $EACH(:grid) AS i FROM m) AS e),
      v AS (SELECT least(cast(ceil((ln(cast(x AS DOUBLE)) - lo) * (:grid - 1) / nullif(hi - lo, 0) - 1e-9) AS INT), :grid - 1) AS i, count(*) AS n FROM {order_counts} CROSS JOIN m WHERE x > 0 GROUP BY 1),
      c AS (SELECT g.i, g.l, g.total, sum(coalesce(v.n, 0)) OVER (ORDER BY g.i) AS upto FROM g LEFT JOIN v ON v.i = g.i),
      z AS (SELECT c.i, c.l, c.upto * 1.0E0 / c.total AS ecdf, f.sigma, (c.l - f.mu) / f.sigma AS z FROM c CROSS JOIN {g3_lognormal_fit} AS f WHERE f.sigma > 0),
      t AS (SELECT *, 1 / (1 + 0.3275911E0 * abs(z) / sqrt(2.0E0)) AS t FROM z), p AS (SELECT *, t * (0.254829592E0 + t * (-0.284496736E0 + t * (1.421413741E0 + t * (-1.453152027E0 + t * 1.061405429E0)))) * exp(-z * z / 2) / 2 AS tail FROM t)
      SELECT i, round(exp(l), 5) AS place, round(ecdf, 6) AS ecdf, round(CASE WHEN z > 0 THEN 1 - tail ELSE tail END, 5) AS cdf, round(exp(-z * z / 2) / (exp(l) * sigma * 2.5066282746310002E0), 6) AS pdf FROM p""", {"grid": 200}),
    spread("g14_param_percentiles", "Percentiles of fitted parameters.", ("g8_weibull_fits",), "SELECT shape, scale FROM {g8_weibull_fits}", (), {"n": "count(*)"}, {f"{c}_p{p}": (c, p / 100, 6) for c in ("shape", "scale") for p in (1, 5, 25, 50, 75, 95, 99)}),
    O("g14_param_correlation", "Correlation of the logarithms of shape and scale.", ("g8_weibull_fits",), "SELECT count(*) AS n, round(corr(ln(shape), ln(scale)), 4) AS r FROM {g8_weibull_fits} WHERE shape > 0 AND scale > 0"),
    spread("g16_gap_by_best_fit", "Median gap by best family.", ("d1_gaps", "g11_fit_gaps"), "SELECT f.best, g.gap / 1e6 AS gap_s FROM {d1_gaps} AS g JOIN {g11_fit_gaps} AS f ON g.did = f.did WHERE g.gap > 0", ("best",), {"n": "count(*)"}, {"median_s": ("gap_s", 0.5, 6)}),
    spread("lifetime_limits", "P0.1 and P99.9 of the lifetimes of posts, in whole microseconds.", ("i2_post_engagement",), "SELECT last_us - created_us AS life FROM {i2_post_engagement} WHERE last_us > created_us", (), {"n": "count(*)"}, {"lo": ("life", 0.001, 0), "hi": ("life", 0.999, 0)}),
    _cut(O("lifetimes", "Lifetimes of posts in whole microseconds, those outside P0.1 to P99.9 left out.", ("i2_post_engagement", "lifetime_limits"), "SELECT 'all' AS did, last_us - created_us AS gap FROM {i2_post_engagement} CROSS JOIN {lifetime_limits} WHERE last_us > created_us AND last_us - created_us BETWEEN lo AND hi")),
    O("lifetime_ranks", "Distinct lifetimes in seconds with how many there are, up to each and in all.", ("lifetimes",), "SELECT x, n, sum(n) OVER (ORDER BY x) AS c, sum(n) OVER () AS total FROM (SELECT gap / 1e6 AS x, count(*) AS n FROM {lifetimes} GROUP BY gap) AS v", {}, _ranks),
    O("lifetime_counts", "The same in whole seconds.", ("lifetimes",), "SELECT did, greatest(cast(round(gap / 1e6) AS BIGINT), 1) AS x FROM {lifetimes}"),
    _cut(O("lifetime_weibull", "Weibull fit of lifetimes.", ("lifetimes",), _weibull().replace("{d1_gaps}", "{lifetimes}"), {"least": 10}, lambda gaps, least=10: weibull.fits(gaps, least))),
    _cut(O("lifetime_powerlaw", "Power law of lifetimes, xmin by KS distance.", ("lifetime_counts",), activity.powerlaw_sql("lifetime_counts"), {"k": 50}, activity.powerlaw)),
    O("g17_rank_families", "Families of lifetimes by log-likelihood, with KS distance; the Pareto on its tail from xmin.", ("lifetime_ranks", "lifetime_weibull", "lifetime_powerlaw"), """WITH p AS (SELECT w.shape, w.scale, q.xmin, q.alpha FROM {lifetime_weibull} AS w CROSS JOIN {lifetime_powerlaw} AS q),
      f AS (SELECT sum(n * x) / sum(n) AS mean, sum(n * ln(x)) / sum(n) AS mu, sqrt(greatest(sum(n * ln(x) * ln(x)) / sum(n) - pow(sum(n * ln(x)) / sum(n), 2), 0.0E0)) AS sd, sum(CASE WHEN x < xmin THEN n ELSE 0 END) AS below, shape, scale, xmin, alpha FROM {lifetime_ranks} CROSS JOIN p GROUP BY shape, scale, xmin, alpha),
      z AS (SELECT x, n, c, total, mean, mu, sd, below, shape, scale, xmin, alpha, (ln(x) - mu) / sd AS z, 1 / (1 + 0.3275911E0 * abs(ln(x) - mu) / sd / sqrt(2.0E0)) AS t FROM {lifetime_ranks} CROSS JOIN f),
      e AS (SELECT *, t * (0.254829592E0 + t * (-0.284496736E0 + t * (1.421413741E0 + t * (-1.453152027E0 + t * 1.061405429E0)))) * exp(-z * z / 2) / 2 AS tail, $EACH(4) AS i FROM z),
      d AS (SELECT i, n, CASE i WHEN 0 THEN -ln(mean) - x / mean WHEN 1 THEN -ln(x) - ln(sd) - 0.5E0 * ln(2 * 3.141592653589793E0) - z * z / 2 WHEN 2 THEN ln(shape / scale) + (shape - 1) * ln(x / scale) - pow(x / scale, shape) ELSE ln((alpha - 1) / xmin) - alpha * ln(x / xmin) END AS ll,
        CASE i WHEN 0 THEN 1 - exp(-x / mean) WHEN 1 THEN CASE WHEN z > 0 THEN 1 - tail ELSE tail END WHEN 2 THEN 1 - exp(-pow(x / scale, shape)) ELSE 1 - pow(x / xmin, 1 - alpha) END AS model,
        (c - CASE WHEN i = 3 THEN below ELSE 0 END) * 1.0E0 AS place, (total - CASE WHEN i = 3 THEN below ELSE 0 END) * 1.0E0 AS of FROM e WHERE i < 3 OR x >= xmin),
      k AS (SELECT CASE i WHEN 0 THEN 'exponential' WHEN 1 THEN 'lognormal' WHEN 2 THEN 'weibull' ELSE 'pareto' END AS family, sum(n * ll) AS log_lik, max(greatest(abs(place / of - model), abs((place - n + 1) / of - model))) AS ks, cast(sum(n) AS BIGINT) AS n FROM d GROUP BY i)
      SELECT row_number() OVER (ORDER BY log_lik / n DESC, family) AS place, family, n, round(log_lik / n, 4) AS mean_log_lik, round(ks, 4) AS ks FROM k"""),
)
