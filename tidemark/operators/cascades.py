"""Repost cascades as trees."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpointed
from tidemark.plans.operator import Operator as O
from tidemark.plans.operator import spread


def depths(nodes: DataFrame) -> DataFrame:
    """(subject_uri, idx, pidx, depth) of the nodes that the root, idx 0, reaches.

    Children of the root are settled at once. Each other node points to an ancestor; every round doubles how far, and settles
    the nodes whose pointer has come to a settled one. Depths have no holes, so the round that settles none is the last: what
    is left then hangs on a ring.
    """
    key = ["subject_uri", "idx"]
    rows = checkpointed(nodes.select("subject_uri", "idx", "pidx"))
    done = [rows.where("idx = 0 OR pidx = 0").withColumn("depth", F.when(F.col("idx") > 0, 1).otherwise(0))]
    left = checkpointed(rows.where("idx > 0 AND pidx > 0").select("*", F.col("pidx").alias("up"), F.lit(1).alias("far")))
    while not left.isEmpty():
        settled = done[-1].where("depth > 0").select("subject_uri", F.col("idx").alias("up"), F.col("depth").alias("base"))
        for d in done[:-1]:
            settled = settled.unionByName(d.where("depth > 0").select("subject_uri", F.col("idx").alias("up"), F.col("depth").alias("base")))
        jump = left.select("subject_uri", F.col("idx").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        met = checkpointed(left.join(settled, ["subject_uri", "up"], "left").join(jump, ["subject_uri", "up"], "left"))
        new = met.where("base IS NOT NULL").select(*key, "pidx", (F.col("far") + F.col("base")).alias("depth"))
        if new.isEmpty():
            break
        done.append(new)
        left = met.where("base IS NULL AND up2 IS NOT NULL").select(*key, "pidx", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def ancestor_closure(nodes: DataFrame) -> DataFrame:
    """(subject_uri, idx, anc, dist) of each node that the root reaches and each of its ancestors, itself included.

    Nodes of depth one need no search. For the others, pairs nearer than 2^k and pairs at just 2^k give all pairs nearer than
    2^(k+1), each once, so rounds grow as the logarithm of the depth.
    """
    known = checkpointed(depths(nodes))
    pair = lambda df, anc, dist: df.select("subject_uri", "idx", anc.cast("long").alias("anc"), dist.cast("int").alias("dist"))
    flat = pair(known, F.col("idx"), F.lit(0)).unionByName(pair(known.where("depth = 1"), F.lit(0), F.lit(1)))
    deep = known.where("depth > 1")
    jump = pair(known.where("depth > 0"), F.col("pidx"), F.lit(1))
    near = checkpointed(pair(deep, F.col("pidx"), F.lit(1)))
    parts, step = [flat, near], 1
    while True:
        on = jump.select("subject_uri", F.col("idx").alias("anc"), F.col("anc").alias("anc2"))
        far = checkpointed(near.join(on, ["subject_uri", "anc"]).select("subject_uri", "idx", F.col("anc2").alias("anc"), (F.col("dist") + step).alias("dist")))
        if far.isEmpty():
            break
        parts.append(far)
        near = near.unionByName(far)
        jump = checkpointed(jump.join(on, ["subject_uri", "anc"]).select("subject_uri", "idx", F.col("anc2").alias("anc"), (F.col("dist") + step).alias("dist")))
        step *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return checkpointed(out)


def shape(nodes: DataFrame) -> DataFrame:
    """(subject_uri, idx, depth, children, size) of the nodes that the root, idx 0, reaches; size counts the nodes under one, itself included.

    No pairs of nodes and ancestors are made: each node holds a pointer that a round sends twice as far up, and the nodes less
    far below it, counted. A node that points to another at just 2^k adds its count to that one's, so rows times the logarithm of
    the depth are the work. Nodes right under the root that have no children stay out of the rounds. A round in which no pointer
    comes to the root is the last: depths have no holes, so what still points elsewhere hangs on a ring or on no node at all.
    """
    key = ["subject_uri", "idx"]
    rows = checkpointed(nodes.select("subject_uri", "idx", "pidx"))
    deep, top = rows.where("idx > 0 AND pidx > 0"), rows.where("idx > 0 AND pidx = 0")
    over = deep.select("subject_uri", F.col("pidx").alias("idx")).distinct()
    start = deep.unionByName(top.join(over, key, "left_semi"))
    state = checkpointed(start.select(*key, "pidx", F.col("pidx").alias("up"), F.lit(1).alias("far"), F.lit(1).cast("long").alias("size")))
    at = F.expr("CASE WHEN up > 0 THEN up ELSE -idx END")  # no two rows whose pointer has come to its end share a key
    counts = lambda df: df.agg(F.count_if(F.col("up") == 0), F.count_if(F.col("up") > 0)).first()
    ended, moving = counts(state)
    while moving:
        more = state.where("up > 0").groupBy("subject_uri", F.col("up").alias("idx")).agg(F.sum("size").alias("more"))
        hop = state.select("subject_uri", F.col("idx").alias("at"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        met = state.join(more, key, "left").withColumn("at", at).join(hop, ["subject_uri", "at"], "left")
        state = checkpointed(met.select(*key, "pidx", F.expr("CASE WHEN up > 0 THEN coalesce(up2, -1) ELSE up END").alias("up"), F.expr("far + coalesce(far2, 0)").alias("far"), F.expr("size + coalesce(more, 0)").alias("size")))
        before = ended
        ended, moving = counts(state)
        if ended == before:
            break
    lone = top.join(over, key, "left_anti").select(*key, "pidx", F.lit(1).alias("depth"), F.lit(1).cast("long").alias("size"))
    reached = state.where("up = 0").select(*key, "pidx", F.col("far").alias("depth"), "size").unionByName(lone)
    kids = checkpointed(reached.groupBy("subject_uri", F.col("pidx").alias("idx")).agg(F.count(F.lit(1)).alias("children")))
    under = kids.groupBy("subject_uri").agg(F.sum("children").alias("under"))
    root = rows.where("idx = 0").join(under, "subject_uri", "left").select(*key, F.lit(0).alias("depth"), (F.coalesce("under", F.lit(0)) + 1).alias("size"))
    out = reached.drop("pidx").unionByName(root).join(kids, key, "left")
    return checkpointed(out.select(*key, "depth", F.coalesce("children", F.lit(0)).cast("long").alias("children"), "size"))


_CLOSURE = """WITH RECURSIVE c AS (SELECT subject_uri, idx, idx AS anc, 0 AS dist FROM {h2_parents} UNION ALL SELECT c.subject_uri, c.idx, n.pidx, c.dist + 1 FROM c JOIN {h2_parents} AS n ON n.subject_uri = c.subject_uri AND n.idx = c.anc WHERE n.idx > 0)
  SELECT subject_uri, idx, anc, dist FROM c"""

OPERATORS = (
    O("h1_cascade_events", "Creations and reposts numbered in each cascade.", ("cascade_log",), "SELECT subject_uri, repost_uri, via_uri, actor_did, time_us, cast(1 AS BIGINT) * row_number() OVER (PARTITION BY subject_uri ORDER BY time_us, CASE WHEN repost_uri IS NULL THEN 0 ELSE 1 END, event_id) - 1 AS idx FROM {cascade_log} WHERE time_us > 0 AND subject_uri IS NOT NULL"),
    O("h2_parents", "Each repost's parent: the last node whose repost it came by, else the root.", ("h1_cascade_events",), """SELECT n.subject_uri, n.idx, n.actor_did, n.time_us, CASE WHEN n.idx > 0 THEN coalesce(v.idx, 0) END AS pidx FROM {h1_cascade_events} AS n
      LEFT JOIN (SELECT subject_uri, repost_uri, max(idx) AS idx FROM {h1_cascade_events} WHERE repost_uri IS NOT NULL GROUP BY subject_uri, repost_uri) AS v ON n.subject_uri = v.subject_uri AND n.via_uri = v.repost_uri"""),
    O("h3_cascade_edges", "Reposts with their parent's author.", ("h2_parents",), "SELECT n.subject_uri, n.idx, n.actor_did, n.time_us, p.actor_did AS parent_did FROM {h2_parents} AS n JOIN {h2_parents} AS p ON n.subject_uri = p.subject_uri AND n.pidx = p.idx WHERE n.idx > 0"),
    O("h_closure", "Ancestors of each node.", ("h2_parents",), _CLOSURE, {}, ancestor_closure),
    O("h_shape", "Depth of each node, its children, and the nodes under it, itself included.", ("h2_parents",), f"""SELECT a.subject_uri, a.idx, a.depth, coalesce(b.children, 0) AS children, b.size FROM (SELECT subject_uri, idx, max(dist) AS depth FROM ({_CLOSURE}) AS p GROUP BY subject_uri, idx) AS a
      JOIN (SELECT subject_uri, anc, count(*) AS size, count(CASE WHEN dist = 1 THEN 1 END) AS children FROM ({_CLOSURE}) AS q GROUP BY subject_uri, anc) AS b ON b.subject_uri = a.subject_uri AND b.anc = a.idx""", {}, shape),
    O("h4_node_depths", "Depth of each node.", ("h_shape",), "SELECT subject_uri, idx, depth FROM {h_shape}"),
    O("h5_out_degrees", "Children of each node that has some.", ("h_shape",), "SELECT subject_uri, idx, children FROM {h_shape} WHERE children > 0"),
    O("h6_subtree_sizes", "Nodes under each node, itself included.", ("h_shape",), "SELECT subject_uri, idx, size FROM {h_shape}"),
    O("h7_structural_virality", "Mean distance between nodes: each edge parts a subtree from the rest, so the sizes' sum and sum of squares give it.", ("h6_subtree_sizes",), """SELECT subject_uri, n, CASE WHEN n > 1 THEN round(2.0E0 * (n * a - b) / (n * (n - 1.0E0)), 9) ELSE 0.0E0 END AS virality
      FROM (SELECT subject_uri, max(size) AS n, coalesce(sum(CASE WHEN idx > 0 THEN size END), 0) AS a, coalesce(sum(CASE WHEN idx > 0 THEN size * size END), 0) AS b FROM {h6_subtree_sizes} GROUP BY subject_uri) AS v"""),
    O("h8_cascades", "A row per cascade.", ("h2_parents", "h_shape", "h7_structural_virality"), """SELECT r.subject_uri, r.author_did, r.creation_time_us, r.size, d.depth, d.max_out_degree, v.virality
      FROM (SELECT subject_uri, max(CASE WHEN idx = 0 THEN actor_did END) AS author_did, max(CASE WHEN idx = 0 THEN time_us END) AS creation_time_us, count(*) AS size FROM {h2_parents} GROUP BY subject_uri) AS r
      JOIN (SELECT subject_uri, max(depth) AS depth, max(children) AS max_out_degree FROM {h_shape} GROUP BY subject_uri) AS d ON r.subject_uri = d.subject_uri JOIN {h7_structural_virality} AS v ON r.subject_uri = v.subject_uri"""),
    O("h10_broadcast_groups", "Children of each parent that the root reaches: its author, size, gaps (true median, and the middle of them by place, the mean of two if they are even), trend.", ("h2_parents", "h4_node_depths"), """WITH g AS (SELECT c.subject_uri, c.pidx, c.idx, c.time_us, c.time_us - lag(c.time_us) OVER w AS gap, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY c.subject_uri, c.pidx) AS k
        FROM {h2_parents} AS c JOIN {h4_node_depths} AS d ON d.subject_uri = c.subject_uri AND d.idx = c.idx WHERE c.idx > 0 WINDOW w AS (PARTITION BY c.subject_uri, c.pidx ORDER BY c.idx)),
      b AS (SELECT subject_uri, pidx, count(*) AS broadcast_size, round(coalesce(avg(gap), 0), 3) AS mean_gap_us, coalesce($P(gap, 0.5), 0.0E0) AS median_gap_us, coalesce(avg(CASE WHEN j IN (floor(k / 2), ceil(k / 2)) AND j > 0 THEN cast(gap AS DOUBLE) END), 0.0E0) AS mid_gap_us,
        CASE WHEN count(*) >= 3 THEN round(regr_slope(gap, j), 3) ELSE 0.0E0 END AS gap_trend, min(time_us) AS first_child_us, max(time_us) AS last_child_us FROM g GROUP BY subject_uri, pidx)
      SELECT b.*, p.actor_did AS parent_did FROM b JOIN {h2_parents} AS p ON p.subject_uri = b.subject_uri AND p.idx = b.pidx"""),
    O("h11_root_to_leaf_paths", "A row per leaf: its author, depth, time from the first hop, time per hop, and the slope of the path's gaps over their place (0 under three hops).", ("h_closure", "h2_parents"), """WITH leaf AS (SELECT a.subject_uri, a.idx, max(dist) AS depth FROM {h_closure} AS a LEFT JOIN (SELECT DISTINCT subject_uri AS s, anc FROM {h_closure} WHERE dist = 1) AS p ON a.subject_uri = p.s AND a.idx = p.anc WHERE p.s IS NULL GROUP BY a.subject_uri, a.idx),
      hops AS (SELECT l.subject_uri, l.idx, l.depth, l.depth - c.dist AS place, n.time_us FROM leaf AS l JOIN {h_closure} AS c ON c.subject_uri = l.subject_uri AND c.idx = l.idx JOIN {h2_parents} AS n ON n.subject_uri = c.subject_uri AND n.idx = c.anc WHERE c.dist < l.depth),
      g AS (SELECT subject_uri, idx, time_us, place, time_us - lag(time_us) OVER (PARTITION BY subject_uri, idx ORDER BY place) AS gap FROM hops),
      t AS (SELECT subject_uri, idx, max(CASE WHEN place = last THEN time_us END) - min(CASE WHEN place = 1 THEN time_us END) AS total, regr_slope(gap, place - 1) AS slope FROM (SELECT *, max(place) OVER (PARTITION BY subject_uri, idx) AS last FROM g) AS z GROUP BY subject_uri, idx)
      SELECT l.subject_uri, l.idx, n.actor_did AS leaf_did, l.depth, coalesce(t.total, 0) AS path_total_time_us, CASE WHEN l.depth > 0 THEN round(t.total * 1.0E0 / l.depth, 3) ELSE 0.0E0 END AS traversal_speed, CASE WHEN l.depth >= 3 THEN round(t.slope, 3) ELSE 0.0E0 END AS gap_trend
      FROM leaf AS l JOIN {h2_parents} AS n ON n.subject_uri = l.subject_uri AND n.idx = l.idx LEFT JOIN t ON t.subject_uri = l.subject_uri AND t.idx = l.idx"""),
    O("h12_cascade_lifetime", "Nearest-rank times to shares of a cascade's reposts.", ("h1_cascade_events",), """WITH r AS (SELECT subject_uri, time_us, idx, min(time_us) OVER (PARTITION BY subject_uri) AS t0, count(*) OVER (PARTITION BY subject_uri) - 1 AS n FROM {h1_cascade_events})
      SELECT subject_uri, n AS total_reposts, max(time_us) - min(t0) AS last_us, """ + ", ".join(f"min(CASE WHEN idx = ceil(0.{p}E0 * n) THEN time_us - t0 END) AS t{p}_us" for p in (50, 95, 99)) + " FROM r WHERE n >= 1 GROUP BY subject_uri, n"),
    O("h14_repost_gaps", "Gaps to the repost before, in the cascade and under the same parent; -1 for none.", ("h2_parents",), "SELECT subject_uri, idx, coalesce(time_us - lag(time_us) OVER (PARTITION BY subject_uri ORDER BY idx), -1) AS global_gap_us, coalesce(time_us - lag(time_us) OVER (PARTITION BY subject_uri, pidx ORDER BY idx), -1) AS topology_gap_us FROM {h2_parents} WHERE idx > 0"),
    O("h15_t50_buckets", "Cascades by time to half their reposts.", ("h12_cascade_lifetime",), "SELECT CASE WHEN t50_us < 60000000 THEN '<1m' WHEN t50_us < 3600000000 THEN '<1h' WHEN t50_us < 21600000000 THEN '<6h' WHEN t50_us < 86400000000 THEN '<1d' ELSE '1d+' END AS bucket, count(*) AS n FROM {h12_cascade_lifetime} WHERE total_reposts >= 2 GROUP BY 1"),
    spread("h16_topology_gap_stats", "Gaps under one parent, in seconds.", ("h14_repost_gaps",), "SELECT topology_gap_us / 1e6 AS gap_s FROM {h14_repost_gaps} WHERE topology_gap_us >= 0", (), {"mean": "round(avg(gap_s), 4)"}, {"p50": ("gap_s", 0.5, 6), "p90": ("gap_s", 0.9, 6)}),
    spread("h18_virality_stats", "Virality over cascades of two or more, and their share of all cascades.", ("h8_cascades",), "SELECT CASE WHEN size >= 2 THEN virality END AS v FROM {h8_cascades}", (), {"n": "count(v)", "coverage_pct": "round(100.0E0 * count(v) / count(*), 6)", "mean": "round(avg(v), 6)", "std": "round(stddev_samp(v), 6)", "least": "min(v)", "most": "max(v)"},
      {n: ("v", p, 6) for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p99_9", 0.999))}),
    O("h20_depth_stats", "Cascades by depth.", ("h8_cascades",), "SELECT depth, count(*) AS n, max(size) AS largest FROM {h8_cascades} GROUP BY depth"),
    O("h20_depth_summary", "Depths of cascades of two or more.", ("h8_cascades",), "SELECT count(*) AS n, round(avg(depth), 6) AS mean, $P(depth, 0.5) AS median, $P(depth, 0.9) AS p90, $P(depth, 0.99) AS p99, max(depth) AS most, round(100.0E0 * count(CASE WHEN depth = 1 THEN 1 END) / count(*), 6) AS depth_1_pct FROM {h8_cascades} WHERE size >= 2"),
    O("h20_virality_regimes", "Cascades of two or more by virality: 1, over 1 to 3, over 3; and how many of each are stars.", ("h8_cascades",), "SELECT CASE WHEN virality <= 1 THEN '1' WHEN virality <= 3 THEN '1-3' ELSE '3+' END AS regime, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct, count(CASE WHEN max_out_degree = size - 1 THEN 1 END) AS stars FROM {h8_cascades} WHERE size >= 2 GROUP BY 1"),
    O("h20_top_viral", "The :k most viral cascades.", ("h8_cascades",), "SELECT subject_uri, author_did, size, depth, max_out_degree, virality FROM {h8_cascades} ORDER BY virality DESC, size DESC, subject_uri LIMIT :k", {"k": 50}),
    O("h9_gap_trend", "Slope of the gaps between a cascade's reposts over their place; 0 under three reposts.", ("h1_cascade_events",), """WITH g AS (SELECT subject_uri, idx - 1 AS j, time_us - lag(time_us) OVER (PARTITION BY subject_uri ORDER BY idx) AS gap FROM {h1_cascade_events} WHERE idx > 0)
      SELECT subject_uri, count(*) AS reposts, CASE WHEN count(*) >= 3 THEN round(regr_slope(gap, j), 3) ELSE 0.0E0 END AS gap_trend FROM g GROUP BY subject_uri"""),
    O("h13_time_to_peak", "Time to the first repost of the fullest of 100 equal bins, the earliest on ties; 0 for one repost or no span.", ("h1_cascade_events",), """WITH r AS (SELECT subject_uri, idx, time_us, min(time_us) OVER p AS t0, max(time_us) OVER p AS t1, count(*) OVER p - 1 AS n FROM {h1_cascade_events} WINDOW p AS (PARTITION BY subject_uri)),
      b AS (SELECT subject_uri, n, CASE WHEN n > 1 AND t1 > t0 THEN least(cast(floor(cast(time_us - t0 AS DOUBLE) / nullif(t1 - t0, 0) * 100) AS BIGINT), 99) ELSE -1 END AS bin, count(*) AS c, min(time_us) - min(t0) AS first_us FROM r WHERE idx > 0 GROUP BY 1, 2, 3)
      SELECT subject_uri, n AS total_reposts, CASE WHEN bin < 0 THEN 0 ELSE first_us END AS time_to_peak_us FROM (SELECT *, row_number() OVER (PARTITION BY subject_uri ORDER BY c DESC, bin) AS place FROM b) AS q WHERE place = 1"""),
    spread("h17_peak_by_size", "Median seconds to the peak by reposts, from two up.", ("h13_time_to_peak",), "SELECT CASE WHEN total_reposts <= 5 THEN '2-5' WHEN total_reposts <= 20 THEN '6-20' WHEN total_reposts <= 100 THEN '21-100' ELSE '100+' END AS bucket, time_to_peak_us / 1e6 AS peak_s FROM {h13_time_to_peak} WHERE total_reposts >= 2", ("bucket",), {"n": "count(*)"}, {"median_peak_s": ("peak_s", 0.5, 6)}),
    spread("h19_virality_by_size", "Virality by size, from two nodes up.", ("h8_cascades",), "SELECT CASE " + " ".join(f"WHEN size <= {hi} THEN '{name}'" for hi, name in ((2, "2"), (3, "3"), (5, "4-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"), (500, "101-500"), (1000, "501-1000"))) + " ELSE '1001+' END AS bucket, virality FROM {h8_cascades} WHERE size >= 2", ("bucket",),
      {"n": "count(*)", "mean": "round(avg(virality), 6)", "most": "max(virality)"}, {"median": ("virality", 0.5, 6), "p90": ("virality", 0.9, 6)}),
)

_PARENTS = next(o for o in OPERATORS if o.name == "h2_parents")
OPERATORS += (
    O("h1_cascade_dump", "Posts as creations and reposts created, with their URIs.", ("cascade_posts", "repost_records"), """SELECT concat('at://', did, '/app.bsky.feed.post/', rkey) AS subject_uri, CAST(NULL AS STRING) AS repost_uri, CAST(NULL AS STRING) AS via_uri, did AS actor_did, time_us, 0 AS is_repost FROM {cascade_posts}
      UNION ALL SELECT subject_uri, concat('at://', did, '/app.bsky.feed.repost/', rkey), via_uri, did, time_us, 1 FROM {repost_records} WHERE collection = 'app.bsky.feed.repost' AND operation = 'create' AND time_us > 0 AND subject_uri IS NOT NULL"""),
    O("h1_dump_events", "Nodes of each cascade by time, a creation first on ties, whatever the first row is.", ("h1_cascade_dump",), "SELECT subject_uri, repost_uri, via_uri, actor_did, time_us, is_repost, cast(1 AS BIGINT) * row_number() OVER (PARTITION BY subject_uri ORDER BY time_us, is_repost, repost_uri) - 1 AS idx FROM {h1_cascade_dump}"),
    O("h1_whole_cascades", "Nodes of the cascades that have a creation, which is their root whatever its time.", ("h1_cascade_dump",), """SELECT subject_uri, repost_uri, via_uri, actor_did, time_us, is_repost, cast(1 AS BIGINT) * row_number() OVER (PARTITION BY subject_uri ORDER BY is_repost, time_us, repost_uri) - 1 AS idx FROM {h1_cascade_dump} AS d
      WHERE EXISTS (SELECT 1 FROM {h1_cascade_dump} AS c WHERE c.subject_uri = d.subject_uri AND c.is_repost = 0)"""),
    O("h1_orphan_reposts", "Reposts of posts that have no creation, set aside: a row per post.", ("h1_cascade_dump",), "SELECT subject_uri, count(*) AS reposts, count(DISTINCT actor_did) AS actors, min(time_us) AS first_us, max(time_us) AS last_us FROM {h1_cascade_dump} GROUP BY subject_uri HAVING max(1 - is_repost) = 0"),
    *(O(name, doc, (events,), _PARENTS.sql.replace("{h1_cascade_events}", f"{{{events}}}")) for name, doc, events in (("h2_dump_parents", "Parents in cascades rooted at their first row.", "h1_dump_events"), ("h2_whole_parents", "Parents in cascades rooted at their creation.", "h1_whole_cascades"))),
)
