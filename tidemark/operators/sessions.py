"""Sessions, gaps between posts, and the regularity of gaps."""

from dataclasses import replace

from tidemark.functions import ranks
from tidemark.functions.lineage import dealt
from tidemark.plans.operator import Operator as O
from tidemark.plans.operator import spread

_ISLANDS = """SELECT did, time_us, sum(CASE WHEN gap > limit_us THEN 1 ELSE 0 END) OVER (PARTITION BY did ORDER BY time_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island"""


def _entropy(symbol: str) -> str:
    return f"""WITH s AS (SELECT did, {symbol} AS sym, count(*) AS n FROM {{d1_gaps}} WHERE gap IS NOT NULL GROUP BY 1, 2)
      SELECT did, cast(sum(n) AS BIGINT) AS num_gaps, count(*) AS num_unique_gaps, round(greatest(ln(cast(sum(n) AS DOUBLE)) / ln(2.0E0) - sum(n * ln(cast(n AS DOUBLE)) / ln(2.0E0)) / sum(n), 0.0E0), 6) AS entropy_bits FROM s GROUP BY did HAVING sum(n) >= 5"""


def _dealt(op: O) -> O:
    """op, its rows dealt by user in Spark: it sorts and sums them several times in one stage."""
    return replace(op, work=lambda ev, **params: op(dealt(ev, "did"), **params))


OPERATORS = (
    _dealt(O("d1_gaps", "Gaps between a user's distinct stamps.", ("ev",), """SELECT did, time_us, time_us - lag(time_us) OVER (PARTITION BY did ORDER BY time_us) AS gap FROM (SELECT DISTINCT did, time_us FROM {ev}) AS s""")),
    O("d2_tukey_threshold", "Q3 + 1.5 (Q3 - Q1) of a user's gaps, in whole microseconds.", ("d1_gaps",), "SELECT did, cast(floor($P(gap, 0.75) + 1.5E0 * ($P(gap, 0.75) - $P(gap, 0.25))) AS BIGINT) AS limit_us FROM {d1_gaps} GROUP BY did HAVING count(*) >= :least", {"least": 5}),
    O("d3_tukey_sessions", "Sessions cut where a gap is over the user's own threshold.", ("d1_gaps", "d2_tukey_threshold"), "SELECT did, min(time_us) AS session_start, max(time_us) AS session_end, round((max(time_us) - min(time_us)) / 1e6, 3) AS duration_s, 0 AS is_singleton FROM (" + _ISLANDS + " FROM {d1_gaps} AS g JOIN {d2_tukey_threshold} AS t USING (did)) AS i GROUP BY did, island"),
    _dealt(O("d4_sessions_rich", "Sessions with floor and fallback thresholds, act counts and the next start.", ("ev",), """WITH g AS (SELECT did, time_us, event_type, time_us - lag(time_us) OVER (PARTITION BY did ORDER BY time_us, event_type) AS gap FROM {ev}),
      t AS (SELECT did, count(gap) AS gaps, CASE WHEN count(gap) < 4 THEN 3600000000 ELSE greatest(120000000, cast(floor($P(gap, 0.75) + 1.5E0 * ($P(gap, 0.75) - $P(gap, 0.25))) AS BIGINT)) END AS limit_us FROM g GROUP BY did HAVING count(*) >= 2),
      i AS (SELECT did, time_us, event_type, gaps, limit_us, sum(CASE WHEN gap > limit_us THEN 1 ELSE 0 END) OVER (PARTITION BY did ORDER BY time_us, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g JOIN t USING (did))
      SELECT did, session_start, session_end, lead(session_start) OVER (PARTITION BY did ORDER BY session_start) AS next_session_start, round((session_end - session_start) / 1e6, 3) AS duration_s, likes, reposts, posts_authored, replies, follows, likes + reposts AS interactions, total_actions,
        round(limit_us / 1e6, 6) AS user_threshold_s, CASE WHEN gaps < 4 THEN 1 ELSE 0 END AS user_threshold_fallback, gaps AS user_gap_count
      FROM (SELECT did, island, limit_us, gaps, min(time_us) AS session_start, max(time_us) AS session_end, count(CASE WHEN event_type = 'feed_like' THEN 1 END) AS likes, count(CASE WHEN event_type = 'feed_repost' THEN 1 END) AS reposts,
        count(CASE WHEN event_type = 'post_top' THEN 1 END) AS posts_authored, count(CASE WHEN event_type = 'post_reply' THEN 1 END) AS replies, count(CASE WHEN event_type = 'graph_follow' THEN 1 END) AS follows, count(*) AS total_actions FROM i GROUP BY did, island, limit_us, gaps) AS s""")),
    O("d5_threshold_sessions", "Sessions cut at a fixed gap.", ("d1_gaps",), "SELECT did, min(time_us) AS session_start, max(time_us) AS session_end, count(*) AS events FROM (" + _ISLANDS.replace("limit_us", ":gap_us") + " FROM {d1_gaps}) AS i GROUP BY did, island", {"gap_us": 265000000}),
    O("d5_wide_sessions", "Sessions cut at a gap of :gap_us, with the next start.", ("d1_gaps",), "SELECT did, session_start, session_end, lead(session_start) OVER (PARTITION BY did ORDER BY session_start) AS next_session_start FROM (SELECT did, min(time_us) AS session_start, max(time_us) AS session_end FROM (" + _ISLANDS.replace("limit_us", ":gap_us") + " FROM {d1_gaps}) AS i GROUP BY did, island) AS s", {"gap_us": 21600000000}),
    spread("d7_session_summary", "Durations over sessions.", ("d3_tukey_sessions",), "SELECT duration_s FROM {d3_tukey_sessions}", (), {"n": "count(*)", "mean": "round(avg(duration_s), 3)"}, {n: ("duration_s", p, 6) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9))}),
    O("d9_session_gaps", "Positive gaps from a session's end to the next start.", ("d3_tukey_sessions",), "SELECT did, session_start, gap_us FROM (SELECT did, session_start, session_start - lag(session_end) OVER (PARTITION BY did ORDER BY session_start) AS gap_us FROM {d3_tukey_sessions} WHERE duration_s >= :least) AS g WHERE gap_us > 0", {"least": 0}),
    O("d8_session_user_stats", "Sessions, median duration and median positive gap per user.", ("d3_tukey_sessions", "d9_session_gaps"), """SELECT s.did, s.n_sessions, s.median_duration_s, g.median_gap_us FROM (SELECT did, count(*) AS n_sessions, round($P(duration_s, 0.5), 6) AS median_duration_s FROM {d3_tukey_sessions} GROUP BY did) AS s
      LEFT JOIN (SELECT did, $P(gap_us, 0.5) AS median_gap_us FROM {d9_session_gaps} GROUP BY did) AS g ON s.did = g.did"""),
    O("real_sessions", "Sessions of some length.", ("d3_tukey_sessions",), "SELECT * FROM {d3_tukey_sessions} WHERE duration_s > 0"),
    O("d10_solo_vs_real", "Sessions of no length against others; medians over all users and over users that have any.", ("d3_tukey_sessions",), """SELECT cast(sum(solo) AS BIGINT) AS solo, cast(sum(real_n) AS BIGINT) AS real_n, count(CASE WHEN real_n = 0 THEN 1 END) AS all_solo_users, $P(real_n, 0.5) AS median_real, $P(CASE WHEN real_n > 0 THEN real_n END, 0.5) AS median_real_any
      FROM (SELECT did, count(CASE WHEN duration_s = 0 THEN 1 END) AS solo, count(CASE WHEN duration_s > 0 THEN 1 END) AS real_n FROM {d3_tukey_sessions} GROUP BY did) AS u"""),
    O("d11_circadian", "Starts and ends of real sessions by quarter of an hour.", ("d3_tukey_sessions",), """SELECT bin, count(CASE WHEN side = 'start' THEN 1 END) AS starts, count(CASE WHEN side = 'end' THEN 1 END) AS ends
      FROM (SELECT side, cast(floor((t_us % 86400000000) / 900000000) AS BIGINT) AS bin FROM (SELECT 'start' AS side, session_start AS t_us FROM {d3_tukey_sessions} WHERE duration_s > 0 UNION ALL SELECT 'end', session_end FROM {d3_tukey_sessions} WHERE duration_s > 0) AS s) AS b GROUP BY bin"""),
    O("d12_peak_hour", "The hours with most starts and with most ends, the lowest on ties.", ("d11_circadian",), """WITH h AS (SELECT cast(floor(bin / 4) AS BIGINT) AS hour, cast(sum(starts) AS BIGINT) AS starts, cast(sum(ends) AS BIGINT) AS ends FROM {d11_circadian} GROUP BY 1)
      SELECT min(CASE WHEN starts = (SELECT max(starts) FROM h) THEN hour END) AS start_hour, max(starts) AS starts, min(CASE WHEN ends = (SELECT max(ends) FROM h) THEN hour END) AS end_hour, max(ends) AS ends FROM h"""),
    spread("d13_hour_limits", "Real sessions and P95 of their durations by hour of start.", ("d3_tukey_sessions",), "SELECT cast(floor((session_start % 86400000000) / 3600000000) AS BIGINT) AS hour, duration_s FROM {d3_tukey_sessions} WHERE duration_s > 0", ("hour",), {"n": "count(*)"}, {"p95": ("duration_s", 0.95, 9)}),
    spread("d13_duration_by_hour", "Durations up to the hour's P95, for hours with over ten sessions.", ("d3_tukey_sessions", "d13_hour_limits"), """SELECT p.hour, s.duration_s FROM {d3_tukey_sessions} AS s JOIN {d13_hour_limits} AS p ON p.hour = cast(floor((s.session_start % 86400000000) / 3600000000) AS BIGINT)
      WHERE p.n > 10 AND s.duration_s > 0 AND s.duration_s <= p.p95""", ("hour",), {"n": "count(*)"}, {n: ("duration_s", p, 6) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}),
    O("d14_session_user_aggregates", "Sessions, acts and thresholds per user.", ("d4_sessions_rich",), "SELECT did, count(*) AS n_sessions, round(avg(duration_s), 3) AS avg_duration_s, round(avg(next_session_start - session_end) / 1e6, 3) AS avg_gap_s, cast(sum(total_actions) AS BIGINT) AS actions, round(avg(total_actions), 6) AS avg_actions, max(user_threshold_s) AS threshold_s, max(user_threshold_fallback) AS fallback FROM {d4_sessions_rich} GROUP BY did"),
    spread("d15_threshold_stats", "Thresholds over users.", ("d14_session_user_aggregates",), "SELECT threshold_s, fallback FROM {d14_session_user_aggregates}", (), {"mean": "round(avg(threshold_s), 3)", "fallback_share": "round(avg(fallback * 1.0E0), 6)"}, {n: ("threshold_s", p, 3) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))}),
    spread("d16_session_global_stats", "Durations and gaps over all sessions, in seconds.", ("d4_sessions_rich",), "SELECT duration_s, (next_session_start - session_end) / 1e6 AS gap_s FROM {d4_sessions_rich}", (),
      {"n": "count(*)", "zero_share": "round(avg(CASE WHEN duration_s = 0 THEN 1.0E0 ELSE 0.0E0 END), 6)", "duration_mean": "round(avg(duration_s), 3)"}, {f"{n}_p{p}": (f"{n}_s", p / 100, 5) for n in ("duration", "gap") for p in (25, 50, 75, 90, 95, 99)}),
    O("d17_action_buckets", "Sessions by number of acts.", ("d4_sessions_rich",), "SELECT CASE WHEN total_actions <= 2 THEN cast(total_actions AS STRING) WHEN total_actions <= 5 THEN '3-5' WHEN total_actions <= 10 THEN '6-10' WHEN total_actions <= 20 THEN '11-20' WHEN total_actions <= 50 THEN '21-50' ELSE '51+' END AS bucket, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {d4_sessions_rich} GROUP BY 1"),
    O("d18_duration_buckets", "Sessions by duration.", ("d4_sessions_rich",), "SELECT CASE WHEN duration_s = 0 THEN '0' WHEN duration_s < 1 THEN '<1' WHEN duration_s < 5 THEN '1-5' WHEN duration_s < 60 THEN '5-60' WHEN duration_s < 300 THEN '60-300' ELSE '300+' END AS bucket, count(*) AS n FROM {d4_sessions_rich} GROUP BY 1"),
    O("d18_duration_labels", "Sessions by duration under five labels.", ("d4_sessions_rich",), "SELECT CASE WHEN duration_s = 0 THEN 'instant' WHEN duration_s < 60 THEN 'under 1 min' WHEN duration_s < 300 THEN '1-5 min' WHEN duration_s < 1800 THEN '5-30 min' ELSE '30+ min' END AS label, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {d4_sessions_rich} GROUP BY 1"),
    O("d21_gap_duration_spearman", "Rank correlation of duration and next gap, ranks from value counts.", ("d4_sessions_rich",), """WITH p AS (SELECT duration_s AS x, next_session_start - session_end AS y FROM {d4_sessions_rich} WHERE duration_s > 0 AND next_session_start > session_end),
      a AS (SELECT x, sum(count(*)) OVER (ORDER BY x) - (count(*) - 1) / 2.0E0 AS rx FROM p GROUP BY x), b AS (SELECT y, sum(count(*)) OVER (ORDER BY y) - (count(*) - 1) / 2.0E0 AS ry FROM p GROUP BY y)
      SELECT count(*) AS n, round(corr(cast(rx AS DOUBLE), cast(ry AS DOUBLE)), 6) AS rho FROM p JOIN a ON p.x = a.x JOIN b ON p.y = b.y""", {}, ranks.spearman),
    O("d22_top_users", "Users with most acts in sessions.", ("d4_sessions_rich",), "SELECT did, cast(sum(total_actions) AS BIGINT) AS actions FROM {d4_sessions_rich} GROUP BY did ORDER BY actions DESC, did LIMIT :k", {"k": 20}),
    O("e1_tag_sessions", "The session that holds each post, if any, by one union and window.", ("posts", "d3_tukey_sessions"), """SELECT did, time_us, rkey, CASE WHEN time_us <= s_end THEN s_start END AS session_start FROM (
      SELECT did, time_us, rkey, kind, max(s_start) OVER w AS s_start, max(s_end) OVER w AS s_end FROM (
        SELECT did, session_start AS time_us, CAST(NULL AS STRING) AS rkey, 0 AS kind, session_start AS s_start, session_end AS s_end FROM {d3_tukey_sessions}
        UNION ALL SELECT did, time_us, rkey, 1, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM {posts}) AS u
      WINDOW w AS (PARTITION BY did ORDER BY time_us, kind, rkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS t WHERE kind = 1"""),
    O("e4_gap_table", "Gaps between a user's posts: all, and those within one session.", ("e1_tag_sessions",), """WITH g AS (SELECT did, session_start, time_us - lag(time_us) OVER w AS gap_us, lag(session_start) OVER w AS before FROM {e1_tag_sessions} WINDOW w AS (PARTITION BY did ORDER BY time_us, rkey))
      SELECT did, round(gap_us / 1e6, 6) AS gap_s, 'global' AS gap_type FROM g WHERE gap_us IS NOT NULL UNION ALL SELECT did, round(gap_us / 1e6, 6), 'within_session' FROM g WHERE session_start = before"""),
    spread("e5_gap_summary", "Positive gaps of each type.", ("e4_gap_table",), "SELECT gap_type, gap_s FROM {e4_gap_table} WHERE gap_s > 0", ("gap_type",), {"n": "count(*)", "mean": "round(avg(gap_s), 4)", "std": "round(stddev_pop(gap_s), 3)", "least": "min(gap_s)", "most": "max(gap_s)"},
      {n: ("gap_s", p, 4) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p99_9", 0.999))}),
    O("e5_gap_ratio", "Median gap within sessions over the median of all.", ("e5_gap_summary",), "SELECT round(max(CASE WHEN gap_type = 'within_session' THEN p50 END) / max(CASE WHEN gap_type = 'global' THEN p50 END), 6) AS within_over_global FROM {e5_gap_summary}"),
    O("f1_gap_entropy", "Entropy of a user's gaps: a gap's symbol is its seconds rounded to 0.1 s and cut to whole ones.", ("d1_gaps",), _entropy("floor(round(gap / 1e6, 1))")),
    O("f1_gap_entropy_nearest", "The same with the nearest whole second as symbol.", ("d1_gaps",), _entropy("floor(gap / 1e6 + 0.5E0)")),
    O("f2_entropy_stats", "Entropy over users.", ("f1_gap_entropy",), "SELECT min(entropy_bits) AS least, " + ", ".join(f"round($P(entropy_bits, 0.{p:02d}), 6) AS p{p}" for p in (1, 5, 10, 50, 90, 95, 99)) + ", max(entropy_bits) AS most FROM {f1_gap_entropy}"),
    O("f4_entropy_extremes", "Most and least regular users.", ("f1_gap_entropy",), """SELECT did, entropy_bits, e AS side FROM (SELECT did, entropy_bits, 'regular' AS e, row_number() OVER (ORDER BY entropy_bits, did) AS r FROM {f1_gap_entropy}
      UNION ALL SELECT did, entropy_bits, 'irregular', row_number() OVER (ORDER BY entropy_bits DESC, did) FROM {f1_gap_entropy}) AS x WHERE r <= 10"""),
    O("d19_session_types", "Sessions by the acts they hold; other acts alone count under two types.", ("d4_sessions_rich",), """WITH t AS (SELECT CASE WHEN likes > 0 AND p + r + f + o = 0 THEN 'likes only' WHEN likes > 0 THEN 'mixed with likes' WHEN p > 0 AND r + f + o = 0 THEN 'posts/replies' WHEN r > 0 AND p + f + o = 0 THEN 'reposts only'
          WHEN f > 0 AND p + r + o = 0 THEN 'network' WHEN p + r + f > 0 THEN 'mixed no likes' ELSE 'other only' END AS type, o
        FROM (SELECT likes, posts_authored + replies AS p, reposts AS r, follows AS f, total_actions - likes - posts_authored - replies - reposts - follows AS o FROM {d4_sessions_rich}) AS s),
      u AS (SELECT type FROM t UNION ALL SELECT 'mixed no likes' FROM t WHERE type = 'other only' AND o > 0)
      SELECT type, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM u GROUP BY type"""),
)

_RICH = next(o for o in OPERATORS if o.name == "d4_sessions_rich")
OPERATORS += (
    _dealt(O("d4_sessions_engaged", "Rich sessions over events but likes.", ("ev_engaged",), _RICH.sql.replace("{ev}", "{ev_engaged}"))),
    O("d20_session_types_engaged", "Sessions over events but likes by the acts they hold.", ("d4_sessions_engaged",), """SELECT type, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (
        SELECT CASE WHEN p + r + f = 0 THEN 'empty' WHEN r + f = 0 THEN 'posts/replies only' WHEN p + f = 0 THEN 'reposts only' WHEN p + r = 0 THEN 'follows/blocks only' ELSE 'mixed' END AS type
        FROM (SELECT posts_authored + replies AS p, reposts AS r, follows AS f FROM {d4_sessions_engaged}) AS s) AS t GROUP BY type"""),
    O("d9_real_gaps", "Positive gaps between real sessions.", ("real_sessions",), next(o for o in OPERATORS if o.name == "d9_session_gaps").sql.replace("{d3_tukey_sessions}", "{real_sessions}"), {"least": 0}),
    O("d8_real_user_stats", "Real sessions, their median duration and median positive gap per user.", ("real_sessions", "d9_real_gaps"), next(o for o in OPERATORS if o.name == "d8_session_user_stats").sql.replace("{d3_tukey_sessions}", "{real_sessions}").replace("{d9_session_gaps}", "{d9_real_gaps}")),
)
