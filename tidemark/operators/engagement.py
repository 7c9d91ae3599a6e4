"""Order and decay of engagement, and the follow graph."""

from tidemark.functions import ranks
from tidemark.plans.operator import Operator as O
from tidemark.plans.operator import spread

_T = ("like", "repost", "reply")

OPERATORS = (
    O("i1_engagement_events", "Likes, reposts and replies with their post's creation.", ("engagement_log",), "SELECT e.k, e.event_id, e.time_us, e.type, c.time_us AS created_us FROM {engagement_log} AS e JOIN (SELECT k, time_us FROM {engagement_log} WHERE idx = 0) AS c ON e.k = c.k WHERE e.idx > 0 AND e.type IS NOT NULL"),
    O("i2_post_engagement", "A row per post.", ("i1_engagement_events",), "SELECT k, " + ", ".join(f"count(CASE WHEN type = '{t}' THEN 1 END) AS n_{t}, min(CASE WHEN type = '{t}' THEN time_us END) AS first_{t}_us" for t in _T) + ", max(time_us) AS last_us, round((max(time_us) - min(created_us)) / 1e6, 6) AS lifetime_s, min(created_us) AS created_us FROM {i1_engagement_events} GROUP BY k"),
    O("i3_coverage", "Posts with each type, with any and with none.", ("i2_post_engagement", "engagement_log"), "SELECT (SELECT count(*) FROM {engagement_log} WHERE idx = 0) AS posts, " + ", ".join(f"count(CASE WHEN n_{t} > 0 THEN 1 END) AS with_{t}, round(100.0E0 * count(CASE WHEN n_{t} > 0 THEN 1 END) / (SELECT count(*) FROM {{engagement_log}} WHERE idx = 0), 6) AS {t}_pct" for t in _T) + ", count(*) AS with_any, (SELECT count(*) FROM {engagement_log} WHERE idx = 0) - count(*) AS with_none, round(100.0E0 * count(*) / (SELECT count(*) FROM {engagement_log} WHERE idx = 0), 6) AS any_pct FROM {i2_post_engagement}"),
    spread("i4_time_to_first", "Seconds to the first of each type.", ("i2_post_engagement",), "SELECT CASE i " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_T)) + " END AS type, (CASE i " + " ".join(f"WHEN {i} THEN first_{t}_us" for i, t in enumerate(_T)) + " END - created_us) / 1e6 AS wait_s FROM (SELECT *, $EACH(3) AS i FROM {i2_post_engagement}) AS e", ("type",),
      {"n": "count(wait_s)", "mean": "round(avg(wait_s), 4)"}, {f"p{p}": ("wait_s", p / 100, 6) for p in (10, 25, 50, 75, 90, 95, 99)}),
    O("i5_first_event", "Which type comes first.", ("i2_post_engagement",), "SELECT CASE " + " ".join(f"WHEN first_{t}_us = least(first_like_us, first_repost_us, first_reply_us) THEN '{t}'" for t in _T) + " END AS first, count(*) AS n FROM {i2_post_engagement} WHERE n_like > 0 AND n_repost > 0 AND n_reply > 0 GROUP BY 1"),
    O("i6_pairwise_order", "Which of two types comes first.", ("i2_post_engagement",), " UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, count(CASE WHEN first_{a}_us < first_{b}_us THEN 1 END) AS a_first, count(CASE WHEN first_{a}_us > first_{b}_us THEN 1 END) AS b_first, count(CASE WHEN first_{a}_us = first_{b}_us THEN 1 END) AS tie FROM {{i2_post_engagement}}" for a, b in (("like", "repost"), ("like", "reply"), ("repost", "reply")))),
    O("i7_transition_matrix", "Chance of the next type given this one.", ("i1_engagement_events",), """WITH n AS (SELECT type, lead(type) OVER (PARTITION BY k ORDER BY time_us, event_id) AS next, count(*) OVER (PARTITION BY k) AS c FROM {i1_engagement_events})
      SELECT type, next, count(*) AS n, round(count(*) * 1.0E0 / sum(count(*)) OVER (PARTITION BY type), 6) AS p FROM n WHERE c >= 3 AND next IS NOT NULL GROUP BY type, next"""),
    O("i8_conditional_probs", "Chance of one type given another.", ("i2_post_engagement",), " UNION ALL ".join(f"SELECT '{a}' AS type, '{b}' AS given, round(count(CASE WHEN n_{a} > 0 AND n_{b} > 0 THEN 1 END) * 1.0E0 / nullif(count(CASE WHEN n_{b} > 0 THEN 1 END), 0), 6) AS p FROM {{i2_post_engagement}}" for a in _T for b in _T if a != b)),
    O("i9_decay_per_post", "Slope of ln rank on ln time.", ("i1_engagement_events",), "SELECT k, count(*) AS n, round(regr_slope(ln(r), ln(t)), 6) AS beta FROM (SELECT k, cast(row_number() OVER (PARTITION BY k ORDER BY time_us, event_id) AS DOUBLE) AS r, (time_us - created_us) / 1e6 AS t FROM {i1_engagement_events} WHERE time_us > created_us) AS x GROUP BY k HAVING count(*) >= 20"),
    O("j2_dense_ids", "Ids from 0 in order of the node.", ("follows",), "SELECT node, cast(1 AS BIGINT) * row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT actor_id AS node FROM {follows} UNION SELECT subject_id FROM {follows}) AS n", {}, ranks.dense_ids),
    O("j2_rekeyed_edges", "Edges with the dense ids of their ends.", ("follows", "j2_dense_ids"), "SELECT actor_id, subject_id, a.id AS actor_no, s.id AS subject_no FROM {follows} AS f JOIN {j2_dense_ids} AS a ON f.actor_id = a.node JOIN {j2_dense_ids} AS s ON f.subject_id = s.node"),
    O("mutual_nodes", "Nodes that follow and are followed.", ("follows",), "SELECT DISTINCT actor_id AS node FROM {follows} WHERE actor_id IN (SELECT subject_id FROM {follows})"),
    O("j4_induced_edges", "Edges between nodes of a set.", ("follows", "mutual_nodes"), "SELECT actor_id, subject_id FROM {follows} WHERE actor_id IN (SELECT node FROM {mutual_nodes}) AND subject_id IN (SELECT node FROM {mutual_nodes})"),
    O("j5_degree_stats", "In and out degrees over all nodes, those without edges on that side too.", ("follows",), """WITH d AS (SELECT node, cast(sum(i) AS BIGINT) AS i, cast(sum(o) AS BIGINT) AS o FROM (SELECT subject_id AS node, 1 AS i, 0 AS o FROM {follows} UNION ALL SELECT actor_id, 0, 1 FROM {follows}) AS e GROUP BY node)
      SELECT count(*) AS nodes, cast(sum(o) AS BIGINT) AS edges, round(sum(o) * 1.0E0 / count(*), 6) AS density, """ + ", ".join(f"round(avg({c}), 6) AS {n}_mean, $P({c}, 0.5) AS {n}_median, max({c}) AS {n}_most" for n, c in (("in", "i"), ("out", "o"))) + " FROM d"),
    O("j6_follower_buckets", "Users by powers of two of followers.", ("follows", "customer"), "SELECT bucket, count(*) AS users, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT CASE WHEN d IS NULL THEN -1 ELSE cast(floor(ln(cast(d AS DOUBLE)) / ln(2.0E0) + 1e-9) AS BIGINT) END AS bucket FROM {customer} LEFT JOIN (SELECT subject_id, count(*) AS d FROM {follows} GROUP BY subject_id) AS f ON c_custkey = subject_id) AS b GROUP BY bucket"),
    O("j7_stratified_batch", "About :n users not yet done, drawn by hash of :seed and user, in proportion to all users' follower buckets, one of each at least; what buckets lack is topped up from the others. Of a bucket only the first of :slices slices of hashes that hold enough are ranked.", ("follows", "users_done"), """WITH f AS (SELECT subject_id, floor(ln(cast(count(*) AS DOUBLE)) / ln(2.0E0) + 1e-9) AS b FROM {follows} GROUP BY subject_id),
      share AS (SELECT b, greatest(ceil(:n * 1.0E0 * count(*) / sum(count(*)) OVER ()), 1) AS most FROM f GROUP BY b),
      u AS (SELECT f.subject_id, f.b, $UNIFORM(':seed:' || f.subject_id) AS u FROM f WHERE NOT EXISTS (SELECT 1 FROM {users_done} AS d WHERE d.subject_id = f.subject_id)),
      c AS (SELECT b, floor(u * :slices) AS slice, count(*) AS n FROM u GROUP BY 1, 2),
      s AS (SELECT b, slice, sum(n) OVER (PARTITION BY b ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM c),
      near AS (SELECT u.subject_id, u.b, u.u, share.most FROM u JOIN s ON s.b = u.b AND s.slice = floor(u.u * :slices) JOIN share ON share.b = u.b WHERE s.before < share.most),
      first AS (SELECT subject_id FROM (SELECT subject_id, most, row_number() OVER (PARTITION BY b ORDER BY u, subject_id) AS r FROM near) AS q WHERE r <= most),
      lack AS (SELECT greatest((SELECT sum(most) FROM share) - count(*), 0) AS n FROM first),
      rest AS (SELECT subject_id, row_number() OVER (ORDER BY u, subject_id) AS r FROM (SELECT subject_id, u FROM u WHERE NOT EXISTS (SELECT 1 FROM first WHERE first.subject_id = u.subject_id) ORDER BY u, subject_id LIMIT :n) AS q)
      SELECT subject_id, false AS topped_up FROM first UNION ALL SELECT subject_id, true FROM rest WHERE r <= (SELECT n FROM lack)""", {"n": 100, "seed": 42, "slices": 4096}),
    O("i9_decay_pooled", "Slope of ln of the events so far on ln time, over quarter-octave time bins of all posts.", ("i1_engagement_events",), """WITH b AS (SELECT cast(floor(4 * ln((time_us - created_us) / 1e6) / ln(2.0E0)) AS INT) AS bin, count(*) AS c FROM {i1_engagement_events} WHERE time_us > created_us GROUP BY 1)
      SELECT count(*) AS bins, round(regr_slope(y, x), 6) AS beta FROM (SELECT (bin + 1) * ln(2.0E0) / 4 AS x, ln(cast(sum(c) OVER (ORDER BY bin) AS DOUBLE)) AS y FROM b) AS s"""),
    O("i9_decay_by_count", "Slopes of posts by number of engagements.", ("i9_decay_per_post",), "SELECT CASE WHEN n < 100 THEN '20-99' WHEN n < 1000 THEN '100-999' WHEN n < 10000 THEN '1K-10K' ELSE '10K+' END AS bucket, count(*) AS posts, round(avg(beta), 5) AS mean, round($P(beta, 0.5), 5) AS median FROM {i9_decay_per_post} GROUP BY 1"),
    O("j1_follow_edges", "Distinct active follows between known users.", ("follow_log", "customer"), "SELECT DISTINCT actor_id, subject_id FROM {follow_log} WHERE valid_to IS NULL AND actor_id IN (SELECT c_custkey FROM {customer}) AND subject_id IN (SELECT c_custkey FROM {customer})"),
)
