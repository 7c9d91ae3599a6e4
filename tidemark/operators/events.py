"""Scans and event-table construction."""

from tidemark.plans.operator import Operator as O
from tidemark.sources.adapters import DAY0, DAY30

# Collections that no event table by rate holds.
EXCLUDED = ("app.bsky.feed.post", "app.bsky.graph.repost", "app.bsky.graph.verification", "app.bsky.lexicon.collection", "app.bsky.graph.cancellation", "app.bsky.draft.createDraft")

_TYPED = """SELECT did, time_us, replace(replace(collection, 'app.bsky.', ''), '.', '_') AS event_type FROM {records} WHERE :keep AND time_us >= :lo AND time_us < :hi
  UNION ALL SELECT did, time_us, CASE WHEN reply_root_uri IS NULL THEN 'post_top' ELSE 'post_reply' END AS event_type FROM {posts} WHERE time_us >= :lo AND time_us < :hi"""
_WINDOW = {"lo": DAY0, "hi": DAY30}
_FREQUENT = "WITH t AS (:typed), u AS (SELECT did FROM t GROUP BY did HAVING count(*) >= :least) SELECT t.* FROM t WHERE did IN (SELECT did FROM u)"


def _built(name: str, doc: str, typed: str, least: int, keep: str) -> O:
    return O(name, doc, ("records", "posts"), _FREQUENT.replace(":typed", typed), {"keep": keep, "least": least, **_WINDOW})


OPERATORS = (
    O("a1_scan_events", "Events in a half-open window.", ("ev",), "SELECT * FROM {ev} WHERE time_us >= :lo AND time_us < :hi", _WINDOW),
    O("a3_json_props", "A field of a JSON column, counted.", ("events",), "SELECT $K AS k, count(*) AS n FROM {events} GROUP BY $K"),
    O("a7_restrict_users", "Events of a list of users (here those that took a repost back).", ("ev", "undoers"), "SELECT * FROM {ev} WHERE did IN (SELECT did FROM {undoers})"),
    O("b1_event_types", "Event-type naming.", ("records", "posts"), f"SELECT event_type, count(*) AS n FROM ({_TYPED}) AS t GROUP BY event_type", {"keep": "true", **_WINDOW}),
    _built("b2_all_events", "Creates and posts of users with eight events or more.", _TYPED, 8, "operation = 'create' AND collection LIKE 'app.bsky.%'"),
    _built("b3_all_events_dedup", "B2 without repeats, eligibility counted after.", f"SELECT DISTINCT did, time_us, event_type FROM ({_TYPED}) AS d", 8, "operation = 'create' AND collection <> 'app.bsky.feed.post'"),
    _built("b4_engaged_events", "B2 without likes, four events or more.", _TYPED, 4, "operation = 'create' AND collection <> 'app.bsky.feed.like'"),
    O("b5_events_by_rate", "All operations but on some collections, and posts; users with :least events or more an active day.", ("records", "posts"), """WITH t AS (SELECT did, time_us, concat(replace(replace(collection, 'app.bsky.', ''), '.', '_'), '_', operation) AS event_type FROM {records} WHERE collection NOT IN (:excluded)
        UNION ALL SELECT did, time_us, CASE WHEN reply_root_uri IS NULL THEN 'post_top' ELSE 'post_reply' END FROM {posts}),
      u AS (SELECT did FROM t GROUP BY did HAVING count(*) >= :least * greatest(count(DISTINCT floor(time_us / 86400000000)), 1)) SELECT t.* FROM t WHERE did IN (SELECT did FROM u)""", {"least": 2, "excluded": ", ".join(f"'{c}'" for c in EXCLUDED)}),
    O("b6_activity_band", "Events of some types (:core) of users with :lo to :hi events.", ("ev",), """SELECT * FROM {ev} WHERE event_type IN (:core)
      AND did IN (SELECT did FROM {ev} GROUP BY did HAVING count(*) BETWEEN :lo AND :hi)""", {"lo": 6, "hi": 500, "core": "'post_top', 'post_reply', 'feed_repost'"}),
    O("b7_strata_coverage", "Share of users and of gaps by events per user.", ("ev",), """WITH u AS (SELECT did, count(*) AS n FROM {ev} GROUP BY did),
      s AS (SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 20 THEN '6-20' WHEN n <= 100 THEN '21-100' WHEN n <= 500 THEN '101-500' ELSE '501+' END AS stratum, n FROM u)
      SELECT stratum, count(*) AS users, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS user_pct, round(100.0E0 * sum(n - 1) / sum(sum(n - 1)) OVER (), 6) AS gap_pct FROM s GROUP BY stratum"""),
    O("b8_validate_events", "Rows, users and types.", ("ev",), """SELECT 'rows' AS metric, count(*) AS value FROM {ev} UNION ALL SELECT 'users', count(DISTINCT did) FROM {ev} UNION ALL SELECT 'types', count(DISTINCT event_type) FROM {ev}"""),
    O("b9_type_breakdown", "Count and share of each type.", ("ev",), "SELECT event_type, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {ev} GROUP BY event_type"),
    O("b10_event_share_topk", "Largest labels over both sources.", ("records", "posts"), """SELECT label, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct
      FROM (SELECT concat(collection, '_', operation) AS label FROM {records} UNION ALL SELECT 'post_create' FROM {posts}) AS t GROUP BY label ORDER BY n DESC, label LIMIT 14"""),
    O("b11_users", "A row per user over both sources, with the commonest language.", ("records", "posts"), """WITH e AS (
        SELECT did, time_us, collection AS kind, CAST(NULL AS STRING) AS lang FROM {records} UNION ALL SELECT did, time_us, 'post', lang FROM {posts}),
      l AS (SELECT did, lang, row_number() OVER (PARTITION BY did ORDER BY count(*) DESC, lang) AS r FROM {posts} WHERE lang IS NOT NULL GROUP BY did, lang)
      SELECT e.did, count(CASE WHEN kind = 'post' THEN 1 END) AS num_posts, count(CASE WHEN kind LIKE '%.like' THEN 1 END) AS num_likes, count(CASE WHEN kind LIKE '%.repost' THEN 1 END) AS num_reposts,
        count(CASE WHEN kind LIKE '%.follow' THEN 1 END) AS num_follows, min(time_us) AS first_seen_us, max(time_us) AS last_seen_us, max(l.lang) AS primary_lang
      FROM e LEFT JOIN l ON e.did = l.did AND l.r = 1 GROUP BY e.did"""),
    O("b12_heavy_consumers", "Users with :posts posts at most and over :likes likes, most likes first.", ("b11_users",), "SELECT did, num_likes, num_reposts, num_follows FROM {b11_users} WHERE num_posts <= :posts AND num_likes > :likes ORDER BY num_likes DESC, did", {"posts": 0, "likes": 0}),
    O("b12_active_span", "Days from a user's first to the last event.", ("b11_users",), "SELECT did, round((last_seen_us - first_seen_us) / 86400000000.0E0, 6) AS active_days FROM {b11_users} WHERE first_seen_us > 0"),
)
