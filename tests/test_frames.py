"""Hand-made frames."""

import math

import numpy as np

from tidemark.operators import cascades, fits, sessions, tails
from tidemark.sources.io import read_cascade_tsv, sample_users
from tidemark.streaming.live import deduplicated, hourly_counts, live_sessions


def op(module, name):
    return {o.name: o for o in module.OPERATORS}[name]


def test_virality_of_star_and_chain(spark):
    nodes = [("s", i, None if i == 0 else 0) for i in range(5)] + [("c", i, None if i == 0 else i - 1) for i in range(5)]
    sizes = op(cascades, "h6_subtree_sizes")(cascades.shape(spark.createDataFrame(nodes, "subject_uri string, idx long, pidx long")))
    got = {r.subject_uri: r.virality for r in op(cascades, "h7_structural_virality")(sizes).collect()}
    assert got == {"s": 1.6, "c": 2.0}


def test_cycles_are_left_out(spark):
    nodes = spark.createDataFrame([("x", 0, None), ("x", 1, 2), ("x", 2, 1), ("x", 3, 3), ("x", 4, 0)], "subject_uri string, idx long, pidx long")
    assert {r.idx for r in cascades.ancestor_closure(nodes).collect()} == {0, 4}


def test_session_needs_a_gap_over_the_threshold(spark):
    ev = spark.createDataFrame([("a", t, "x") for t in (0, 1, 2, 3, 4, 5, 6, 7, 1000)], "did string, time_us long, event_type string")
    gaps = op(sessions, "d1_gaps")(ev)
    assert op(sessions, "d3_tukey_sessions")(gaps, op(sessions, "d2_tukey_threshold")(gaps)).count() == 2


def test_tsv_reader(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\t\\N\tNULL\td\t5\t0\n\nshort\trow\nb\tr\tv\td\tnoon\t1\nb\tr\tv\td\t7\t1\n")
    rows = read_cascade_tsv(spark, str(tmp_path)).orderBy("time_us").collect()
    assert [(r.subject_uri, r.repost_uri, r.via_uri, r.time_us, r.is_repost) for r in rows] == [("a", None, None, 5, False), ("b", "r", "v", 7, True)]


def test_sample_users_keeps_whole_users(spark):
    df = spark.createDataFrame([(f"u{i % 10}", i) for i in range(100)], "did string, x int")
    assert sample_users(df, 3, 1).groupBy("did").count().where("count = 10").count() == 3


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:04:25"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 01:00:00"), ("b", "2024-01-01 01:00:00")]
    # A session leaves once the watermark has passed its end.
    df = spark.createDataFrame(rows, "did string, t string").selectExpr("did", "cast(t as timestamp) ts", "'x' event_type")
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, make, want in (("s", live_sessions, 3), ("h", hourly_counts, 2), ("d", deduplicated, 4)):
        q = make(read()).writeStream.format("memory").queryName(f"q_{name}").outputMode("complete" if name == "h" else "append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        got = spark.table(f"q_{name}").count()
        assert got == want if name != "s" else 0 < got < want  # the session that is open is not yet out


def gaps(spark, values):
    return spark.createDataFrame([("a", i, int(x * 1e6)) for i, x in enumerate(values)], "did string, time_us long, gap long")


def test_gamma_and_weibull_fits_are_the_most_likely(spark):
    x = np.round(np.random.default_rng(7).weibull(0.7, 500) * 30 + 1e-3, 6)
    g = op(fits, "g8_gamma_fits")(gaps(spark, x)).first()
    w = op(fits, "g8_weibull_fits")(gaps(spark, x)).first()
    gamma = lambda k: len(x) * (k * math.log(k / x.mean()) - math.lgamma(k)) + ((k - 1) * np.log(x) - k / x.mean() * x).sum()
    weibull = lambda k, s: (np.log(k / s) + (k - 1) * np.log(x / s) - (x / s) ** k).sum()
    assert abs(w.shape - 0.7) < 0.1 and abs(g.rate - g.shape / x.mean()) < 1e-6
    for d in (0.99, 1.01):
        assert gamma(g.shape) > gamma(g.shape * d)
        assert weibull(w.shape, w.scale) > max(weibull(w.shape * d, w.scale), weibull(w.shape, w.scale * d))


def test_elbow_of_a_falling_histogram(spark):
    counts = [400, 200, 100, 20, 10, 9, 8, 7, 6, 5]
    elbow = op(fits, "d23_gap_elbow")(gaps(spark, [60 * i + 1 for i, c in enumerate(counts) for _ in range(c)]), bins=10).first().elbow_s
    assert elbow == 3.5 * 60


def test_fits_of_nothing(spark):
    none = gaps(spark, [1.0]).limit(0)
    assert op(fits, "g8_gamma_fits")(none).count() == op(fits, "g8_weibull_fits")(none).count() == 0
    assert op(fits, "d23_gap_elbow")(none).first().elbow_s is None


def test_peak_is_in_the_earliest_fullest_bin(spark):
    times = [0, 5, 500, 501, 980, 981, 1000]
    log = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [("b", 0, 3), ("b", 1, 9)], "subject_uri string, idx long, time_us long")
    assert {r.subject_uri: r.time_to_peak_us for r in op(cascades, "h13_time_to_peak")(log).collect()} == {"a": 500, "b": 0}


def test_other_acts_alone_count_twice(spark):
    rows = [(1, 0, 0, 0, 0, 1), (0, 0, 0, 0, 0, 2), (0, 1, 1, 0, 0, 2)]
    s = spark.createDataFrame(rows, "likes long, reposts long, posts_authored long, replies long, follows long, total_actions long")
    assert {r.type: r.n for r in op(sessions, "d19_session_types")(s).collect()} == {"likes only": 1, "other only": 1, "mixed no likes": 2}


def test_power_law_of_a_pareto_user_and_vuong(spark):
    rng = np.random.default_rng(7)
    pareto = 20 * (1 - rng.random(800)) ** (-1 / 1.5)
    steady = rng.exponential(50, 800)
    gaps = spark.createDataFrame([(u, int(x * 1e6)) for u, xs in (("p", pareto), ("e", steady), ("few", steady[:9])) for x in xs], "did string, gap long")
    ops = {o.name: o for o in tails.OPERATORS}
    fit = ops["g6_user_powerlaw"](gaps)
    got = {r.did: r for r in fit.collect()}
    assert abs(got["p"].alpha - 2.5) < 0.3 and "few" not in got
    kept = [x for x in pareto if x >= got["p"].xmin]
    assert got["p"].n_tail == len(kept) and abs(got["p"].alpha - 1 - len(kept) / np.log(np.array(kept) / got["p"].xmin).sum()) < 1e-5
    tail = ops["g7_tail"](gaps, fit)
    tests = {r.did: r for r in ops["g9_vuong"](tail, fit, ops["g9_cut_lognormal"](tail, fit)).collect()}
    assert tests["p"].r_exponential > 2 and tests["p"].p_exponential < 0.05


def test_closure_of_a_chain_beside_cycles(spark):
    from tidemark.operators.cascades import ancestor_closure

    chain = [("a", i, i - 1 if i else None) for i in range(40)]
    nodes = [*chain, ("a", 40, 42), ("a", 41, 40), ("a", 42, 41), ("b", 0, None), ("b", 1, 2), ("b", 2, 3), ("b", 3, 1), ("b", 4, 1)]
    got = {tuple(r) for r in ancestor_closure(spark.createDataFrame(nodes, "subject_uri string, idx long, pidx long")).collect()}
    assert got == {("a", i, j, i - j) for i in range(40) for j in range(i + 1)} | {("b", 0, 0, 0)}


def test_rings_and_deep_chains(spark):
    chain = [("a", i, i - 1 if i else None) for i in range(70)]
    rings = [("a", 70 + i, 70 + (i + 1) % 3) for i in range(3)] + [("a", 73, 72)] + [("r", 0, None)] + [(f"r", 1 + 3 * k + i, 1 + 3 * k + (i + 1) % 3) for k in range(20) for i in range(3)]
    nodes = spark.createDataFrame([*chain, *rings], "subject_uri string, idx long, pidx long")
    assert {tuple(r) for r in cascades.depths(nodes).select("subject_uri", "idx", "depth").collect()} == {("a", i, i) for i in range(70)} | {("r", 0, 0)}
    assert cascades.ancestor_closure(nodes).count() == 70 * 71 // 2 + 1
    assert cascades.ancestor_closure(nodes.limit(0)).count() == 0


def test_shape_equals_counting_in_plain_python(spark):
    rng = np.random.default_rng(11)
    forests = {"empty": [None], "none": [None, 7, 1], "chain": [None, *range(500)], "star": [None] + [0] * 50, "ring": [None, 0, 1, 4, 3, 4, 6]}
    forests |= {f"r{t}": [None] + [int(rng.integers(max(0, i - 3), i + (rng.random() < 0.05))) for i in range(1, 40)] for t in range(12)}
    want = set()
    for name, parents in forests.items():
        path = {}
        for i in range(len(parents)):
            way = [i]
            while way[-1] and len(way) <= len(parents) and (parents[way[-1]] or 0) < len(parents):
                way.append(parents[way[-1]])
            if way[-1] == 0:
                path[i] = way
        for i in path:
            want.add((name, i, len(path[i]) - 1, sum(p[1] == i for p in path.values() if len(p) > 1), sum(i in p for p in path.values())))
    nodes = spark.createDataFrame([(n, i, p) for n, ps in forests.items() for i, p in enumerate(ps)], "subject_uri string, idx long, pidx long")
    got = [tuple(r) for r in cascades.shape(nodes).select("subject_uri", "idx", "depth", "children", "size").collect()]
    assert set(got) == want and len(got) == len(want)
    assert cascades.shape(nodes.limit(0)).count() == 0


def tree(spark):
    """Root 0 with children 1 to 4 at 10, 11, 20 and 22; 5 and 6 under 1, 7 under 5, 8 under 7; 9 and 10 hang on each other."""
    rows = [(0, "r", 0, None), (1, "a", 10, 0), (2, "b", 11, 0), (3, "c", 20, 0), (4, "d", 22, 0), (5, "e", 30, 1), (6, "f", 34, 1), (7, "g", 50, 5), (8, "h", 51, 7), (9, "x", 60, 10), (10, "y", 61, 9)]
    return spark.createDataFrame([("p", *r) for r in rows], "subject_uri string, idx long, actor_did string, time_us long, pidx long")


def test_broadcast_groups_by_hand(spark):
    nodes = tree(spark)
    depth = op(cascades, "h4_node_depths")(cascades.shape(nodes))
    got = {r.pidx: r for r in op(cascades, "h10_broadcast_groups")(nodes, depth).collect()}
    assert set(got) == {0, 1, 5, 7}  # 9 and 10 are not reached
    assert (got[0].broadcast_size, got[0].mean_gap_us, got[0].median_gap_us, got[0].mid_gap_us, got[0].parent_did) == (4, 4, 2, 9, "r")
    assert got[0].gap_trend == 0.5 and (got[1].mean_gap_us, got[1].mid_gap_us, got[1].gap_trend) == (4, 4, 0)
    assert (got[5].broadcast_size, got[5].mean_gap_us, got[5].mid_gap_us, got[5].first_child_us) == (1, 0, 0, 50)


def test_paths_by_hand(spark):
    nodes = tree(spark)
    got = {r.leaf_did: r for r in op(cascades, "h11_root_to_leaf_paths")(cascades.ancestor_closure(nodes), nodes).collect()}
    assert set(got) == set("bcdfh")
    assert (got["h"].depth, got["h"].path_total_time_us, got["h"].traversal_speed) == (4, 41, 10.25)
    assert got["h"].gap_trend == -9.5  # gaps 20, 20, 1
    assert (got["b"].depth, got["b"].path_total_time_us, got["b"].gap_trend) == (1, 0, 0) and got["f"].traversal_speed == 12


def test_virality_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    parents = {t: [None] + [int(rng.integers(0, i)) for i in range(1, 3 + 3 * t)] for t in range(8)}
    nodes = spark.createDataFrame([(str(t), i, p) for t, ps in parents.items() for i, p in enumerate(ps)], "subject_uri string, idx long, pidx long")
    got = {r.subject_uri: r.virality for r in op(cascades, "h7_structural_virality")(op(cascades, "h6_subtree_sizes")(cascades.shape(nodes))).collect()}
    for t, ps in parents.items():
        n = len(ps)
        d = np.zeros((n, n))
        for i in range(1, n):
            d[i, :i] = d[:i, i] = d[ps[i], :i] + 1
        assert abs(got[str(t)] - d.sum() / (n * (n - 1))) < 1e-6


def test_root_is_the_first_row_and_vias_resolve_to_the_last(spark):
    log = [("p", "r1", None, "a", 1, 1), ("p", "r2", "r1", "b", 2, 2), ("p", "r2", "nowhere", "c", 3, 3), ("p", "r4", "r2", "d", 4, 4), ("p", "r5", "r5", "e", 5, 5)]
    events = op(cascades, "h1_cascade_events")(spark.createDataFrame(log, "subject_uri string, repost_uri string, via_uri string, actor_did string, time_us long, event_id long"))
    got = {r.idx: r.pidx for r in op(cascades, "h2_parents")(events).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 2, 4: 4}  # no creation row; a repeated uri counts as its last node; a via to itself


def test_thresholds_and_entropy_by_hand(spark):
    stamps = np.cumsum([0, 1_600_000, 1_960_000, 5_000_000, 9_000_000, 10_000_000])
    ev = spark.createDataFrame([("a", int(t), "x") for t in stamps] + [("a", 0, "x")] + [("few", t, "x") for t in range(4)], "did string, time_us long, event_type string")
    g = op(sessions, "d1_gaps")(ev)
    want = np.quantile([1.6e6, 1.96e6, 5e6, 9e6, 10e6], [0.25, 0.75])
    assert {r.did: r.limit_us for r in op(sessions, "d2_tukey_threshold")(g).collect()} == {"a": int(want[1] + 1.5 * (want[1] - want[0]))}
    e = op(sessions, "f1_gap_entropy")(g).first()
    assert (e.did, e.num_gaps, e.num_unique_gaps) == ("a", 5, 5) and abs(e.entropy_bits - math.log2(5)) < 1e-6  # 1.6 s is 1, 1.96 s is 2


def test_posts_on_the_edges_of_sessions(spark):
    posts = spark.createDataFrame([("a", t, str(t)) for t in (5, 10, 15, 20, 25, 30, 40, 99)], "did string, time_us long, rkey string")
    held = spark.createDataFrame([("a", 10, 20), ("a", 30, 40)], "did string, session_start long, session_end long")
    assert {r.time_us: r.session_start for r in op(sessions, "e1_tag_sessions")(posts, held).collect()} == {5: None, 10: 10, 15: 10, 20: 10, 25: None, 30: 30, 40: 30, 99: None}


def test_lifetimes_by_nearest_rank(spark):
    times = [0, 10, 20, 30, 100]
    log = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [("b", 0, 5)], "subject_uri string, idx long, time_us long")
    got = op(cascades, "h12_cascade_lifetime")(log).collect()
    assert [(r.subject_uri, r.total_reposts, r.t50_us, r.t95_us, r.t99_us, r.last_us) for r in got] == [("a", 4, 20, 100, 100, 100)]


def test_repost_gaps_by_hand(spark):
    got = {r.idx: (r.global_gap_us, r.topology_gap_us) for r in op(cascades, "h14_repost_gaps")(tree(spark)).collect()}
    assert got[1] == (-1, -1) and got[2] == (1, 1) and got[5] == (8, -1) and got[6] == (4, 4) and got[10] == (1, -1)


def test_transitions_by_hand(spark):
    from tidemark.operators import engagement

    rows = [(1, i, i, t) for i, t in enumerate(("like", "repost", "like", "reply"))] + [(2, 9, 1, "like"), (2, 10, 2, "reply")]
    got = {(r.type, r.next): (r.n, r.p) for r in op(engagement, "i7_transition_matrix")(spark.createDataFrame(rows, "k int, event_id long, time_us long, type string")).collect()}
    assert got == {("like", "repost"): (1, 0.5), ("like", "reply"): (1, 0.5), ("repost", "like"): (1, 1.0)}


def test_ties_of_the_dominant_act(spark):
    from tidemark.operators import activity

    rows = [("a", 4, 0.25, 0.25, 0.25, 0.25, 0.0), ("b", 4, 0.0, 0.5, 0.5, 0.0, 0.0), ("c", 8, 0.0, 0.0, 0.0, 0.5, 0.5)]
    got = op(activity, "c14_dominant_activity")(spark.createDataFrame(rows, "did string, total long, create_r double, engage_r double, amplify_r double, connect_r double, block_r double"))
    assert {r.dominant: (r.users, r.q1_total) for r in got.collect()} == {"create": (1, 4), "engage": (1, 4), "connect": (1, 8)}


def test_heavy_consumers(spark):
    from tidemark.operators import events

    rows = [("a", 0, 50, 1, 2, 0, 86400000000), ("b", 1, 90, 0, 0, 1, 1), ("c", 0, 5, 0, 0, 1, 1)]
    users = spark.createDataFrame(rows, "did string, num_posts long, num_likes long, num_reposts long, num_follows long, first_seen_us long, last_seen_us long")
    assert [r.did for r in op(events, "b12_heavy_consumers")(users, likes=10).collect()] == ["a"]
    assert [r.did for r in op(events, "b12_heavy_consumers")(users, likes=10, posts=5).collect()] == ["b", "a"]


def test_density_sessions(spark):
    from tidemark.operators.density import density_labels, density_sessions

    blobs = np.array([0, 1, 2, 3, 1000, 1001, 1002, 5000.0])
    got = density_labels(blobs, 2, 1, 60.0)
    assert len(set(got[:4])) == len(set(got[4:7])) == 1 and got[0] != got[4] and -1 not in got[:7] and got[7] == -1
    assert (density_labels(np.array([0.0, 5]), 2, 1, 60.0) == -1).all()  # the whole line is no cluster
    rng = np.random.default_rng(2)
    centres = np.cumsum(rng.uniform(5000, 9000, 12))
    stamps = np.sort(np.concatenate([c + rng.uniform(0, 40, 9) for c in centres]))
    labels = density_labels(stamps, 2, 1, 60.0)
    near = np.cumsum(np.append(0, np.diff(stamps) > 60))
    assert len(set(labels)) == 12 and all(len(set(labels[near == k])) == 1 for k in range(12))
    rows = [("a", int(t * 1e6)) for t in blobs] + [("a", 0), ("one", 5)]
    out = density_sessions(spark.createDataFrame(rows, "did string, time_us long")).orderBy("session_start").collect()
    assert [(r.session_start / 1e6, r.session_end / 1e6, r.is_singleton) for r in out] == [(0, 3, 0), (1000, 1002, 0), (5000, 5000, 1)]


def test_forest_fires_nest_and_repeat(spark):
    from tidemark.operators.forest_fire import forest_fire

    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (300, 2))] + [(3, 3)], "actor_id long, subject_id long")
    got = [tuple(r) for r in forest_fire(edges, (10, 25)).collect()]
    assert got == [tuple(r) for r in forest_fire(edges, (10, 25)).collect()]
    assert [r[1] for r in got] == list(range(25)) and len({r[0] for r in got}) == 25 and [r[2] for r in got] == [10] * 10 + [25] * 15
    assert len(forest_fire(spark.createDataFrame([(1, 2)], "actor_id long, subject_id long"), (9,)).collect()) == 2
    assert forest_fire(edges.limit(0)).count() == 0


def test_ranks_over_ranges(spark):
    from tidemark.functions import ranks

    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, 500)
    got = {r.x: (r.n, r.ecdf, r.ccdf, r.ccdf_inclusive) for r in ranks.ecdf(spark.createDataFrame([(int(v),) for v in x], "x long")).collect()}
    assert all(got[v][0] == (x == v).sum() and abs(got[v][1] - (x <= v).mean()) < 1e-8 and abs(got[v][2] - (x > v).mean()) < 1e-8 and abs(got[v][3] - (x >= v).mean()) < 1e-8 for v in set(x.tolist()))


def test_readers_and_exports(spark, tmp_path):
    from tidemark.sources.io import export_sessions, read_event_log, sample_rows

    (tmp_path / "log" / "2024" / "01").mkdir(parents=True)
    (tmp_path / "log" / "2024" / "01" / "x.jsonl").write_text('{"did": "a", "time_us": 5, "operation": "create", "collection": "c", "rkey": "k", "record": {"$type": "t", "subject": {"uri": "s"}, "via": {"uri": "v"}}}\n{"did": "b", "time_us": 6, "operation": "delete", "collection": "c", "rkey": "l"}\n')
    rows = {r.did: r for r in read_event_log(spark, str(tmp_path / "log")).collect()}
    assert (rows["a"].subject_uri, rows["a"].via_uri, rows["a"].type, rows["b"].type) == ("s", "v", "t", None)
    held = spark.createDataFrame([("b", 5, 6, 1e-6), ("a", 9, 9, 0.0), ("a", 1, 2, 1e-6)], "did string, session_start long, session_end long, duration_s double")
    export_sessions(held, str(tmp_path / "out"), "raw")
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["did", "session_start", "session_end", "duration_s", "source"] and sorted((r.did, r.session_start, r.source) for r in back.collect()) == [("a", "1", "raw"), ("a", "9", "raw"), ("b", "5", "raw")]
    some = spark.range(10000)
    assert sample_rows(some, 10, 3).collect() == sample_rows(some, 10, 3).collect() and 800 < sample_rows(some, 10, 3).count() < 1200


def test_names_are_registered_once():
    import pytest

    from tidemark.plans.operator import Catalog, Operator

    book = Catalog()
    book.add(Operator("x", "", (), "SELECT 1"))
    with pytest.raises(ValueError):
        book.add(Operator("x", "", (), "SELECT 2"))
