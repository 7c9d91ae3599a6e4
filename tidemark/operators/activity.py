"""Activity tables: counts, percentiles, histograms, distributions of values."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import powerlaw as tails
from tidemark.functions import ranks
from tidemark.functions.lineage import checkpointed
from tidemark.plans.operator import Operator as O

_RATIOS = ("create", "engage", "amplify", "connect")
_KINDS = {"posts": "post", "replies": "reply", "likes": "app.bsky.feed.like", "reposts": "app.bsky.feed.repost", "follows": "app.bsky.graph.follow", "blocks": "app.bsky.graph.block", "profiles": "app.bsky.actor.profile"}


def powerlaw_sql(values: str) -> str:
    """Of the rows with one value, those that come first and last are the farthest from the model."""
    return f"""WITH v AS (SELECT cast(x AS DOUBLE) AS x, cast(count(*) AS DOUBLE) AS n FROM {{{values}}} WHERE x > 0 GROUP BY x),
      w AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS place, count(*) OVER () AS m FROM v WHERE x <= (SELECT $P(x, 0.5) FROM {{{values}}} WHERE x > 0)),
      c AS (SELECT x AS xmin FROM w WHERE m <= :k OR place IN (SELECT cast(floor(i * (m - 1.0E0) / (:k - 1)) AS BIGINT) FROM (SELECT $EACH(:k) AS i) AS g CROSS JOIN (SELECT max(m) AS m FROM w) AS q)),
      a AS (SELECT xmin, sum(n) AS t, 1 + sum(n) / nullif(sum(n * ln(x / xmin)), 0) AS alpha FROM c JOIN v ON x >= xmin GROUP BY xmin HAVING sum(n) >= 10),
      e AS (SELECT xmin, t, alpha, n, sum(n) OVER (PARTITION BY xmin ORDER BY x) AS upto, 1 - pow(x / xmin, 1 - alpha) AS model FROM a JOIN v ON x >= xmin),
      b AS (SELECT xmin, round(alpha, 6) AS alpha, round(max(greatest(abs(upto / t - model), abs((upto - n + 1) / t - model))), 6) AS ks, cast(t AS BIGINT) AS n_tail FROM e GROUP BY xmin, alpha, t ORDER BY round(max(greatest(abs(upto / t - model), abs((upto - n + 1) / t - model))), 9), xmin LIMIT 1)
      SELECT CASE WHEN n < 20 THEN 1.0E0 ELSE xmin END AS xmin, CASE WHEN n < 20 THEN 2.0E0 ELSE alpha END AS alpha, CASE WHEN n < 20 THEN 1.0E0 ELSE ks END AS ks, CASE WHEN n < 20 THEN n ELSE n_tail END AS n_tail FROM (SELECT count(*) AS n FROM {{{values}}} WHERE x > 0) AS s LEFT JOIN b ON 1 = 1"""


def powerlaw(values: DataFrame, k: int = 50) -> DataFrame:
    counts = checkpointed(tails.value_counts(values, F.col("x")))
    found = tails.best(tails.fits(counts, tails.candidates_to_median(counts, k), ties=True))
    one = found.agg(*[F.first(c).alias(c) for c in ("xmin", "alpha", "ks", "t")])
    both = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(one)  # one row on either side
    few = lambda value, c: F.when(F.col("n") < 20, value).otherwise(c)
    return both.select(few(1.0, F.col("xmin")).alias("xmin"), few(2.0, F.round("alpha", 6)).alias("alpha"), few(1.0, F.round("ks", 6)).alias("ks"), few(F.col("n"), F.col("t").cast("long")).alias("n_tail"))


OPERATORS = (
    O("c1_collection_operations", "Operations of each collection.", ("records",), """SELECT collection, count(*) AS total, count(CASE WHEN operation = 'create' THEN 1 END) AS creates, count(CASE WHEN operation = 'delete' THEN 1 END) AS deletes,
      count(CASE WHEN operation NOT IN ('create', 'delete') THEN 1 END) AS updates, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {records} GROUP BY collection"""),
    O("c2_user_reach", "Users of each type as a share of all.", ("ev",), """SELECT event_type, count(DISTINCT did) AS users, round(100.0E0 * count(DISTINCT did) / (SELECT count(DISTINCT did) FROM {ev}), 6) AS pct FROM {ev} GROUP BY event_type"""),
    O("c3_events_per_day", "Events per UTC day and source.", ("records", "posts"), "SELECT source, cast(floor(time_us / 86400000000) AS BIGINT) AS day, count(*) AS n FROM (SELECT 'records' AS source, did, time_us FROM {records} UNION ALL SELECT 'posts', did, time_us FROM {posts}) AS e GROUP BY 1, 2"),
    O("c4_events_per_hour", "Events per UTC hour of day and source.", ("records", "posts"), "SELECT source, cast(floor((time_us % 86400000000) / 3600000000) AS BIGINT) AS hour, count(*) AS n FROM (SELECT 'records' AS source, did, time_us FROM {records} UNION ALL SELECT 'posts', did, time_us FROM {posts}) AS e GROUP BY 1, 2"),
    O("c5_user_overlap", "Users of records, of posts, of either and of one alone.", ("records", "posts"), """SELECT count(a.did) AS a, count(b.did) AS b, count(*) AS either, count(CASE WHEN b.did IS NULL THEN 1 END) AS a_only, count(CASE WHEN a.did IS NULL THEN 1 END) AS b_only
      FROM (SELECT DISTINCT did FROM {records}) AS a FULL OUTER JOIN (SELECT DISTINCT did FROM {posts}) AS b ON a.did = b.did"""),
    O("c6_events_per_user", "Users by number of events.", ("ev",), "SELECT n AS events, count(*) AS users FROM (SELECT did, count(*) AS n FROM {ev} GROUP BY did) AS u GROUP BY n"),
    O("c6_engaged_per_user", "Users by number of posts, reposts, follows and blocks created.", ("records", "posts"), """SELECT n AS events, count(*) AS users FROM (SELECT did, count(*) AS n FROM (SELECT did FROM {posts} UNION ALL SELECT did FROM {records}
      WHERE operation = 'create' AND collection IN ('app.bsky.feed.repost', 'app.bsky.graph.follow', 'app.bsky.graph.block')) AS e GROUP BY did) AS u GROUP BY n"""),
    O("c7_percentiles", "Percentiles with linear interpolation.", ("order_counts",), "SELECT " + ", ".join(f"$P(x, 0.{p:02d}) AS p{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)) + " FROM {order_counts}"),
    O("c8_collection_user_stats", "Per-user counts within each collection.", ("records",), """SELECT collection, count(*) AS users, $P(n, 0.5) AS median, $P(n, 0.9) AS p90, $P(n, 0.99) AS p99, max(n) AS most
      FROM (SELECT collection, did, count(*) AS n FROM {records} WHERE operation = 'create' GROUP BY collection, did) AS u GROUP BY collection"""),
    O("c9_events_per_active_day", "Events per active day of each user.", ("ev",), "SELECT did, count(*) AS events, count(DISTINCT floor(time_us / 86400000000)) AS days, round(count(*) * 1.0E0 / count(DISTINCT floor(time_us / 86400000000)), 6) AS per_day FROM {ev} GROUP BY did"),
    O("c10_events_per_active_hour", "Events per active hour of each user.", ("ev",), "SELECT did, count(*) AS events, count(DISTINCT floor(time_us / 3600000000)) AS hours, round(count(*) * 1.0E0 / count(DISTINCT floor(time_us / 3600000000)), 6) AS per_hour FROM {ev} GROUP BY did"),
    O("c11_activity_ratios", "Shares of a user's acts, of any operation.", ("c12_activity_counts",), "SELECT did, total, " + ", ".join(f"round(({c}) * 1.0E0 / total, 6) AS {r}_r" for r, c in (("create", "posts + replies"), ("engage", "likes"), ("amplify", "reposts"), ("connect", "follows"), ("block", "blocks"))) + " FROM {c12_activity_counts} WHERE total > 0"),
    O("c12_activity_counts", "Counts of a user's acts, of any operation: records by collection, posts by kind.", ("records", "posts"), """WITH e AS (SELECT did, collection AS kind FROM {records} UNION ALL SELECT did, CASE WHEN reply_root_uri IS NULL THEN 'post' ELSE 'reply' END FROM {posts})
      SELECT did, """ + ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS {n}" for n, k in _KINDS.items()) + """, count(CASE WHEN kind NOT IN (""" + ", ".join(f"'{k}'" for k in _KINDS.values()) + """) THEN 1 END) AS other_records, count(*) AS total FROM e GROUP BY did"""),
    O("c13_ratio_summary", "Each ratio over users.", ("c11_activity_ratios",), " UNION ALL ".join(f"SELECT '{r}' AS ratio, round(100.0E0 * count(CASE WHEN {r}_r = 0 THEN 1 END) / count(*), 6) AS zero_pct, round($P({r}_r, 0.5), 6) AS median, round($P({r}_r, 0.75), 6) AS p75, round($P({r}_r, 0.9), 6) AS p90, round($P({r}_r, 0.99), 6) AS p99 FROM {{c11_activity_ratios}}" for r in _RATIOS)),
    O("c14_dominant_activity", "Largest ratio of each user, earlier ones first on ties.", ("c11_activity_ratios",), """SELECT dominant, count(*) AS users, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct, $P(total, 0.25) AS q1_total, $P(total, 0.5) AS median_total, $P(total, 0.75) AS q3_total FROM (SELECT total, CASE """ + " ".join(f"WHEN {r}_r = greatest(create_r, engage_r, amplify_r, connect_r) THEN '{r}'" for r in _RATIOS) + " END AS dominant FROM {c11_activity_ratios}) AS d GROUP BY dominant"),
    O("c15_log_histogram", "Log-spaced bins between :edges edges, the last closed.", ("order_counts",), """SELECT bin, count(*) AS n FROM (SELECT least(cast(floor((:edges - 1) * (log10(x) - lo) / nullif(hi - lo, 0) + 1e-9) AS BIGINT), :edges - 2) AS bin
      FROM {order_counts}, (SELECT log10(min(x)) AS lo, log10(max(x)) AS hi FROM {order_counts} WHERE x > 0) AS m WHERE x > 0) AS b WHERE bin >= 0 GROUP BY bin""", {"edges": 20}),
    O("c15_session_histogram", "Log-spaced bins of durations; those under 0.1 s fall out.", ("session_lengths",), """SELECT bin, count(*) AS n FROM (SELECT least(cast(floor((:edges - 1) * (log10(x) - lo) / nullif(hi - lo, 0) + 1e-9) AS BIGINT), :edges - 2) AS bin
      FROM {session_lengths}, (SELECT greatest(log10(min(x)), -1) AS lo, log10(max(x)) + 0.1E0 AS hi FROM {session_lengths} WHERE x > 0) AS m WHERE x > 0) AS b WHERE bin >= 0 GROUP BY bin""", {"edges": 60}),
    O("c15_integer_histogram", "Whole values in bins between log-spaced edges from the least to 10^0.1 times the greatest, rounded to whole numbers, each once, the last bin closed.", ("order_counts",), """WITH m AS (SELECT greatest(log10(min(x)), -1) AS lo, log10(max(x)) + 0.1E0 AS hi FROM {order_counts} WHERE x > 0),
      d AS (SELECT DISTINCT cast(round(pow(10.0E0, lo + i * (hi - lo) / (:edges - 1)), 0) AS BIGINT) AS edge FROM (SELECT lo, hi, $EACH(:edges) AS i FROM m) AS g),
      e AS (SELECT edge, lead(edge) OVER (ORDER BY edge) AS upto, row_number() OVER (ORDER BY edge) - 1 AS bin, count(*) OVER () AS m FROM d),
      w AS (SELECT edge, upto, bin, $SPAN(edge, last) AS x FROM (SELECT edge, upto, bin, CASE WHEN bin = m - 2 THEN upto ELSE upto - 1 END AS last FROM e WHERE upto IS NOT NULL) AS q),
      v AS (SELECT x, count(*) AS n FROM {order_counts} WHERE x > 0 GROUP BY x)
      SELECT w.bin, w.edge, w.upto, cast(sum(v.n) AS BIGINT) AS n FROM w JOIN v ON v.x = w.x GROUP BY w.bin, w.edge, w.upto""", {"edges": 60}),
    O("session_lengths", "Durations of sessions.", ("d3_tukey_sessions",), "SELECT did, duration_s AS x FROM {d3_tukey_sessions}"),
    O("c16_histogram", "Equal bins over a fixed range.", ("order_counts",), "SELECT bin, count(*) AS n FROM (SELECT cast(floor((x - :lo) * :n / (:hi - :lo)) AS BIGINT) AS bin FROM {order_counts} WHERE x >= :lo AND x < :hi) AS b GROUP BY bin", {"lo": 0, "hi": 50, "n": 25}),
    O("c16_clipped_histogram", "Equal bins from the least value to the percentile :clip, values over it left out, the last bin closed.", ("session_lengths",), """SELECT bin, count(*) AS n FROM (SELECT least(cast(floor((x - lo) * :n / nullif(hi - lo, 0)) AS BIGINT), :n - 1) AS bin
      FROM {session_lengths}, (SELECT min(x) AS lo, $P(x, :clip) AS hi FROM {session_lengths}) AS m WHERE x <= hi) AS b GROUP BY bin""", {"n": 25, "clip": 0.95}),
    O("c17_density_grid", "Cells of two logged values.", ("c9_events_per_active_day",), "SELECT cast(floor(log10(events) * 10 + 1e-9) AS BIGINT) AS cx, cast(floor(log10(days) * 10 + 1e-9) AS BIGINT) AS cy, count(*) AS n FROM {c9_events_per_active_day} GROUP BY 1, 2"),
    O("c17_density_cells", "Cells of two values, :nx by :ny, even between the least and the greatest of each, by logarithm if :log is 1; the last cells closed.", ("session_sizes",), """WITH v AS (SELECT CASE WHEN :log = 1 THEN log10(cast(x AS DOUBLE)) ELSE cast(x AS DOUBLE) END AS x, CASE WHEN :log = 1 THEN log10(cast(y AS DOUBLE)) ELSE cast(y AS DOUBLE) END AS y FROM {session_sizes} WHERE x > 0 AND y > 0),
      m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)
      SELECT cx, cy, count(*) AS n FROM (SELECT coalesce(least(cast(floor((x - x0) * :nx / nullif(x1 - x0, 0) + 1e-9) AS BIGINT), :nx - 1), 0) AS cx, coalesce(least(cast(floor((y - y0) * :ny / nullif(y1 - y0, 0) + 1e-9) AS BIGINT), :ny - 1), 0) AS cy FROM v CROSS JOIN m) AS c GROUP BY cx, cy""", {"nx": 50, "ny": 50, "log": 1}),
    O("session_sizes", "Acts and duration of each session.", ("d4_sessions_rich",), "SELECT total_actions AS x, duration_s AS y FROM {d4_sessions_rich}"),
    O("c18_ecdf", "ECDF and both CCDFs over distinct values.", ("order_counts",), """WITH s AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS c, sum(n) OVER () AS t FROM (SELECT x, count(*) AS n FROM {order_counts} GROUP BY x) AS v)
      SELECT x, n, round(c * 1.0E0 / t, 9) AS ecdf, round(1 - c * 1.0E0 / t, 9) AS ccdf, round(1 - (c - n) * 1.0E0 / t, 9) AS ccdf_inclusive FROM s""", {}, ranks.ecdf),
    O("c19_kde_grid", "Gaussian density on an even grid of :grid places from the least value to the greatest, Scott bandwidth, from distinct values, each of which tells on the places within :reach bandwidths; what lies beyond is under exp(-reach^2 / 2) of the kernel's top.", ("order_counts",), """WITH v AS (SELECT x, count(*) AS n FROM {order_counts} GROUP BY x),
      m AS (SELECT t, h, lo, (hi - lo) / (:grid - 1.0E0) AS wide FROM (SELECT count(*) AS t, stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi FROM {order_counts}) AS q),
      r AS (SELECT x, n, t, h, lo, wide, cast(greatest(ceil((x - :reach * h - lo) / nullif(wide, 0)), 0) AS INT) AS a, cast(least(floor((x + :reach * h - lo) / nullif(wide, 0)), :grid - 1) AS INT) AS b FROM v CROSS JOIN m WHERE wide > 0),
      e AS (SELECT x, n, t, h, lo, wide, $SPAN(a, b) AS i FROM r WHERE a <= b), p AS (SELECT i, sum(n * exp(-0.5E0 * pow((lo + i * wide - x) / h, 2))) / max(t * h * 2.5066282746310002E0) AS density FROM e GROUP BY i)
      SELECT g.i, round(m.lo + g.i * m.wide, 6) AS place, round(coalesce(p.density, 0.0E0), 9) AS density FROM (SELECT $EACH(:grid) AS i) AS g CROSS JOIN m LEFT JOIN p ON p.i = g.i""", {"grid": 200, "reach": 6}),
    O("c19_circular_kde", "Density of the hour of day of real sessions' starts, on :grid even places of a day that runs round; bandwidth :factor of the deviation.", ("d3_tukey_sessions",), """WITH v AS (SELECT floor((session_start % 86400000000) / 60000000) / 60.0E0 AS x, cast(count(*) AS DOUBLE) AS n FROM {d3_tukey_sessions} WHERE duration_s > 0 GROUP BY 1),
      m AS (SELECT sum(n) AS t, :factor * sqrt((sum(n * x * x) + sum(n * (x - 24) * (x - 24)) + sum(n * (x + 24) * (x + 24))) / (3 * sum(n)) - pow(sum(n * x) / sum(n), 2)) AS h FROM v),
      p AS (SELECT x, n, i, t, h, i * 24.0E0 / :grid AS place FROM (SELECT x, n, $EACH(:grid) AS i FROM v) AS e CROSS JOIN m)
      SELECT i, max(place) AS hour, round(sum(n * (exp(-0.5 * pow((place - x) / h, 2)) + exp(-0.5 * pow((place - x - 24) / h, 2)) + exp(-0.5 * pow((place - x + 24) / h, 2)))) / max(t * h * 2.5066282746310002), 9) AS density FROM p GROUP BY i""", {"grid": 96, "factor": 0.3}),
    O("c20_variability", "Events per active bin of some hours: mean, deviation, CV.", ("ev",), """SELECT did, count(*) AS bins, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(stddev_pop(n) / avg(n), 6) AS cv
      FROM (SELECT did, floor(time_us / (:hours * 3600000000)) AS bin, count(*) AS n FROM {ev} GROUP BY 1, 2) AS b GROUP BY did""", {"hours": 4}),
    O("c21_variability_summary", "CV over users.", ("c20_variability",), "SELECT " + ", ".join(f"round($P(cv, 0.{p:02d}), 6) AS p{p}" for p in (5, 25, 50, 75, 90, 95, 99)) + ", " + ", ".join(f"round(avg(CASE WHEN cv <= {x} THEN 1.0E0 ELSE 0.0E0 END), 6) AS {n}" for n, x in (("under_half", 0.5), ("under_1", 1), ("under_2", 2))) + ", round(avg(CASE WHEN bins = 1 THEN 1.0E0 ELSE 0.0E0 END), 6) AS one_bin FROM {c20_variability}"),
    O("c22_lognormal_thresholds", "Thresholds of a fitted lognormal and of percentiles, and the users strictly below each.", ("order_counts",), """WITH f AS (SELECT avg(ln(x)) AS mu, stddev_pop(ln(x)) AS sd, $P(x, 0.1) AS p10, $P(x, 0.25) AS p25 FROM {order_counts}),
      t AS (SELECT x, mu, sd, exp(mu - 2 * sd) AS a, exp(mu - sd) AS b, p10 AS c, p25 AS d, exp(mu) AS e FROM {order_counts} CROSS JOIN f)
      SELECT round(max(mu), 6) AS mu, round(max(sd), 6) AS sd, """ + ", ".join(f"round(max({c}), 6) AS {n}, round(100.0E0 * count(CASE WHEN x < {c} THEN 1 END) / count(*), 6) AS {n}_pct" for c, n in zip("abcde", ("mu_less_2sd", "mu_less_sd", "p10", "p25", "exp_mu"), strict=True)) + " FROM t"),
    O("g3_lognormal_fit", "Lognormal by maximum likelihood.", ("order_counts",), "SELECT round(mu, 6) AS mu, round(sd, 6) AS sigma, round(exp(mu), 6) AS median, round(exp(mu + sd * sd / 2), 6) AS mean, round(exp(mu - sd * sd), 6) AS mode, n FROM (SELECT avg(ln(x)) AS mu, stddev_pop(ln(x)) AS sd, count(*) AS n FROM {order_counts}) AS f"),
    O("g1_powerlaw_fit", "Power law: :k of the distinct values to the median, evenly by place, as xmin; least KS distance over all rows wins; (1, 2, 1) under twenty values.", ("order_counts",), powerlaw_sql("order_counts"), {"k": 50}, powerlaw),
    O("c2_collection_reach", "Users that create in each collection, and posts of each kind, as a share of all; major from 1 % up.", ("records", "posts"), """WITH a AS (SELECT collection AS kind, did FROM {records} WHERE operation = 'create' UNION ALL SELECT 'posts', did FROM {posts}
        UNION ALL SELECT CASE WHEN reply_root_uri IS NULL THEN 'posts_top' ELSE 'posts_reply' END, did FROM {posts}), t AS (SELECT did FROM {records} UNION SELECT did FROM {posts})
      SELECT kind, users, round(100.0E0 * users / (SELECT count(*) FROM t), 6) AS pct, users * 100 >= (SELECT count(*) FROM t) AS is_major FROM (SELECT kind, count(DISTINCT did) AS users FROM a GROUP BY kind) AS k"""),
)

_CELLS = next(o for o in OPERATORS if o.name == "c17_density_cells")
OPERATORS += (replace(_CELLS, name="c17_linear_cells", doc="The same without logarithms.", params={**_CELLS.params, "log": 0}),)
