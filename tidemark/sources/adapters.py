"""Views that give the test tables the schemas of the operators' inputs."""

from tidemark.plans.operator import Operator as O

DAY0, DAY30 = 1704067200000000, 1706659200000000

ADAPTERS = (
    O("ev", "Events: did, time_us, event_type.", ("events",), """SELECT concat('did:', cast(user_id AS STRING)) AS did, $US AS time_us,
  CASE event_type WHEN 'view' THEN 'feed_like' WHEN 'click' THEN 'feed_repost' WHEN 'purchase' THEN 'post_top' WHEN 'signup' THEN 'post_reply' ELSE 'graph_follow' END AS event_type FROM {events}"""),
    O("records", "Records with collection and operation.", ("events",), """SELECT concat('did:', cast(user_id AS STRING)) AS did, $US AS time_us,
  CASE event_type WHEN 'view' THEN 'app.bsky.feed.like' WHEN 'click' THEN 'app.bsky.feed.repost' ELSE 'app.bsky.graph.follow' END AS collection,
  CASE WHEN event_id % 20 = 0 THEN 'delete' WHEN event_id % 20 = 1 THEN 'update' ELSE 'create' END AS operation, cast(event_id AS STRING) AS rkey
  FROM {events} WHERE event_type IN ('view', 'click', 'error')"""),
    O("posts", "Posts with language and reply root.", ("events",), """SELECT concat('did:', cast(user_id AS STRING)) AS did, $US AS time_us, cast(event_id AS STRING) AS rkey,
  CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'en' END AS lang, CASE WHEN event_type = 'signup' THEN concat('post:', cast($K AS STRING)) END AS reply_root_uri
  FROM {events} WHERE event_type IN ('purchase', 'signup')"""),
    O("cascade_log", "Creations and reposts as dumped: subject_uri, repost_uri, via_uri, actor_did, time_us.", ("events",), """SELECT concat('post:', cast(k AS STRING)) AS subject_uri,
  CASE WHEN idx > 0 THEN concat('r:', cast(k AS STRING), ':', cast(idx AS STRING)) END AS repost_uri,
  CASE WHEN idx > 0 AND event_id % 10 < 3 AND greatest(idx - 1 - event_id % 5, 0) > 0 THEN concat('r:', cast(k AS STRING), ':', cast(greatest(idx - 1 - event_id % 5, 0) AS STRING)) END AS via_uri,
  concat('did:', cast(user_id AS STRING)) AS actor_did, time_us, event_id
  FROM (SELECT $K AS k, event_id, user_id, $US AS time_us, cast(1 AS BIGINT) * row_number() OVER (PARTITION BY $K ORDER BY ts, event_id) - 1 AS idx FROM {events}) AS z"""),
    O("cascade_rows", "Events of each cascade, numbered, with the author of the first.", ("events",), """SELECT k, idx, event_id, event_type, user_id, time_us, first_value(user_id) OVER (PARTITION BY k ORDER BY idx) AS author
  FROM (SELECT $K AS k, event_id, event_type, user_id, $US AS time_us, cast(1 AS BIGINT) * row_number() OVER (PARTITION BY $K ORDER BY ts, event_id) - 1 AS idx FROM {events}) AS z"""),
    O("cascade_posts", "The posts that cascades begin with, but for those that are follows in the log: their post is missing.", ("cascade_rows",), "SELECT concat('did:', cast(user_id AS STRING)) AS did, cast(k AS STRING) AS rkey, time_us FROM {cascade_rows} WHERE idx = 0 AND event_type <> 'error'"),
    O("repost_records", "What follows the first of a cascade as records: likes, and reposts that are created, updated or deleted, with the repost they came by.", ("cascade_rows",), """SELECT concat('did:', cast(a.user_id AS STRING)) AS did, cast(a.event_id AS STRING) AS rkey, a.time_us, CASE WHEN a.event_type = 'view' THEN 'app.bsky.feed.like' ELSE 'app.bsky.feed.repost' END AS collection,
  CASE WHEN a.event_type = 'error' THEN 'delete' ELSE 'create' END AS operation, concat('at://did:', cast(a.author AS STRING), '/app.bsky.feed.post/', cast(a.k AS STRING)) AS subject_uri, CASE WHEN b.idx > 0 THEN concat('at://did:', cast(b.user_id AS STRING), '/app.bsky.feed.repost/', cast(b.event_id AS STRING)) END AS via_uri
  FROM {cascade_rows} AS a LEFT JOIN {cascade_rows} AS b ON a.k = b.k AND b.idx = a.idx - 1 - a.event_id % 5 AND b.idx > 0 AND a.event_id % 10 < 3 WHERE a.idx > 0"""),
    O("engagement_log", "Engagements of one post per k: the first event creates it.", ("events",), """SELECT k, event_id, time_us, idx,
  CASE event_type WHEN 'view' THEN 'like' WHEN 'click' THEN 'repost' WHEN 'signup' THEN 'reply' END AS type
  FROM (SELECT $K AS k, event_id, event_type, $US AS time_us, cast(1 AS BIGINT) * row_number() OVER (PARTITION BY $K ORDER BY ts, event_id) - 1 AS idx FROM {events}) AS z"""),
    O("follows", "Follow edges: actor_id, subject_id.", ("orders", "customer"), """SELECT DISTINCT o_custkey AS actor_id, (o_orderkey * 7919) % (SELECT count(*) FROM {customer}) AS subject_id
  FROM {orders} WHERE o_orderstatus <> 'P' AND o_custkey <> (o_orderkey * 7919) % (SELECT count(*) FROM {customer})"""),
    O("undoers", "Users that took a repost back.", ("records",), "SELECT DISTINCT did FROM {records} WHERE operation = 'delete' AND collection LIKE '%.repost'"),
    O("users_done", "Users whose followers are known already: the followed with an order that is open.", ("follow_log",), "SELECT DISTINCT subject_id FROM {follow_log} WHERE valid_to = 1"),
    O("order_counts", "A heavy-tailed count per customer.", ("orders",), "SELECT o_custkey AS did, count(*) AS x FROM {orders} GROUP BY o_custkey"),
    O("ev_engaged", "Events but likes.", ("ev",), "SELECT did, time_us, event_type FROM {ev} WHERE event_type <> 'feed_like'"),
    O("follow_log", "Follow records with the time they ended, if they did.", ("orders", "customer"), "SELECT o_custkey AS actor_id, (o_orderkey * 7919) % (SELECT count(*) FROM {customer}) AS subject_id, CASE WHEN o_orderstatus = 'P' THEN 1 END AS valid_to FROM {orders}"),
)
