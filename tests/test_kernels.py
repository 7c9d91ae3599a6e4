"""Quantiles, power laws, cut lognormals, draws and fires against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import normal, powerlaw, ranks
from tidemark.operators import activity, cascades, engagement, fits, forest_fire
from tidemark.plans.operator import spread
from tidemark.sources import io


def op(module, name):
    return {o.name: o for o in module.OPERATORS}[name]


def test_quantiles_of_hot_and_small_keys(spark):
    rng = np.random.default_rng(1)
    values = {"hot": np.round(rng.lognormal(0, 1, 3000), 2).tolist(), "one": [4.0], "ties": [1.0, 1.0, 1.0, 9.0], None: [2.0, 3.0]}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs] + [("one", None)], "k string, x double")
    got = {r.k: r for r in ranks.quantiles(df, ["k"], {"a": 0.25, "b": 0.5, "c": 0.99}).collect()}
    assert set(got) == set(values)
    for k, xs in values.items():
        assert np.allclose([got[k].a, got[k].b, got[k].c], np.quantile(xs, [0.25, 0.5, 0.99]), rtol=1e-12)
    assert [tuple(r) for r in ranks.quantiles(df.limit(0), [], {"a": 0.5}).collect()] == [(None,)]


def test_spread_equals_percentile(spark):
    df = spark.createDataFrame([(i % 2, float(i * i % 97)) for i in range(400)], "g int, v double")
    o = spread("t", "", ("t",), "SELECT g, v FROM {t}", ("g",), {"n": "count(*)"}, {"p50": ("v", 0.5, 6), "p90": ("v + 1", 0.9, 6)})
    assert {tuple(r) for r in o(df).select("g", "n", "p50", "p90").collect()} == {tuple(r) for r in spark.sql(o.text(0), t=df).select("g", "n", "p50", "p90").collect()}
    whole = spread("t", "", ("t",), "SELECT v FROM {t}", (), {"n": "count(*)"}, {"p50": ("v", 0.5, 6)})
    assert [(r.n, r.p50) for r in whole(df.limit(0)).collect()] == [(0, None)]


def test_running_sums_by_ranges(spark):
    rows = [("hot", i, 1) for i in range(500)] + [(f"k{i % 7}", i, 2) for i in range(60)]
    got = ranks.running(spark.createDataFrame(rows, "k string, i long, v long").repartition(5), [F.col("i").desc()], {"s": F.col("v")}, ["k"]).collect()
    for r in got:
        own = [(i, v) for k, i, v in rows if k == r.k]
        assert r.s == sum(v for i, v in own if i >= r.i) and r.s_of == sum(v for _, v in own)


def plain_powerlaw(data, k=50):
    """First of the least KS distances over all rows; (1, 2, 1) under twenty."""
    data = np.sort(np.array([x for x in data if x > 0], float))
    if len(data) < 20:
        return 1.0, 2.0, 1.0, len(data)
    some = np.unique(data[data <= np.median(data)])
    if len(some) > k:
        some = some[np.linspace(0, len(some) - 1, k, dtype=int)]
    best = None
    for xmin in some:
        tail = data[data >= xmin]
        if len(tail) >= 10 and (logs := np.log(tail / xmin).sum()) > 0:
            alpha = 1 + len(tail) / logs
            ks = np.abs(np.arange(1, len(tail) + 1) / len(tail) - (1 - (tail / xmin) ** (1 - alpha))).max()
            if best is None or round(ks, 9) < round(best[2], 9):
                best = xmin, alpha, ks, len(tail)
    return best


@pytest.mark.parametrize("seed,n", [(1, 400), (2, 4000), (3, 30), (4, 12)])
def test_power_law_on_ties_equals_plain_python(spark, seed, n):
    data = np.floor(np.random.default_rng(seed).pareto(1.3, n) * 4 + 1).tolist()
    r = activity.powerlaw(spark.createDataFrame([(x,) for x in [*data, 0.0, -3.0]], "x double")).first()
    want = plain_powerlaw(data)
    assert (r.xmin, r.n_tail) == (want[0], want[3]) and abs(r.alpha - want[1]) < 1e-5 and abs(r.ks - want[2]) < 1e-5


def test_power_law_of_given_counts(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").groupBy("o_custkey").count().select(F.col("count").alias("x"))
    r, want = activity.powerlaw(orders).first(), plain_powerlaw([r.x for r in orders.collect()])
    assert r.xmin == want[0] and abs(r.alpha - want[1]) < 1e-5


def test_plans_have_no_inequality_join(spark, capsys):
    counts = spark.range(100).select(F.lit("a").alias("k"), (F.col("id") + 1).cast("double").alias("x"), F.lit(1).alias("n"))
    powerlaw.fits(counts, powerlaw.candidates_by_log(counts, ["k"], 10), ["k"]).explain()
    assert "NestedLoop" not in (out := capsys.readouterr().out) and "Cartesian" not in out


def test_cut_lognormal_beats_a_grid(spark):
    rng = np.random.default_rng(3)
    cut = {"wide": (0.5, rng.normal(0.0, 1.0, 4000)), "near": (-1.0, rng.normal(2.0, 0.7, 500)), "low": (1.5, rng.normal(-1.0, 1.5, 90000))}
    cut = {k: (a, y[y > a]) for k, (a, y) in cut.items()}
    cut["pareto"] = (0.0, rng.exponential(1.0, 50) ** 1.5)
    rows = [(k, a, float((y - a).mean()), float(((y - a) ** 2).mean() / (y - a).mean() ** 2)) for k, (a, y) in cut.items()]
    got = {r.did: r for r in normal.truncated(spark.createDataFrame(rows, "did string, a double, m1 double, q double")).collect()}
    assert set(got) == {"wide", "near", "low"}  # the others' limit is the exponential

    def loss(k, mu, sigma):
        a, y = cut[k]
        return -len(y) * (math.log(sigma) + math.log(math.erfc((a - mu) / sigma / math.sqrt(2)) / 2)) - ((y - mu) ** 2).sum() / (2 * sigma * sigma)

    for k, r in got.items():
        top = loss(k, r.mu, r.sigma)
        assert abs(r.ln_q - math.log(math.erfc((cut[k][0] - r.mu) / r.sigma / math.sqrt(2)) / 2)) < 1e-4
        for m in np.linspace(-0.5, 0.5, 21):
            for s in np.linspace(0.7, 1.4, 21):
                assert loss(k, r.mu + m, r.sigma * s) <= top + 1e-4 * abs(top) ** 0.5


def test_bootstrap_tells_a_power_law_from_another(spark):
    rng = np.random.default_rng(5)
    true = np.floor((3 - 0.5) * (1 - rng.random(3000)) ** (-1 / 1.5) + 0.5)
    false = np.concatenate([rng.integers(40, 60, 2000), rng.integers(1, 5, 1000)])
    fit, draws, boot = op(fits, "g2_powerlaw_discrete"), op(fits, "g2_draws"), op(fits, "g2_bootstrap")
    p = {}
    for name, xs in (("true", true), ("false", false)):
        found = fit(spark.createDataFrame([(float(x),) for x in xs], "x double"))
        some = draws(found, rounds=20, most=2000)
        p[name] = boot(some, found).first()
        if name == "true":
            assert boot(draws(found, rounds=20, most=2000), found).first() == p[name]
    assert p["true"].rounds == 20 and 0.1 <= p["true"].p <= 1 and p["false"].p == 0


def test_smoothed_knee(spark):
    ys = [max(0, 30 - abs(i - 12) * 3) + (25 if i > 14 else 0) + (i * 7 % 5) for i in range(40)]
    bins = spark.createDataFrame([(i + 3, y, 0.1) for i, y in enumerate(ys)], "i int, y long, wide double")
    sql = op(fits, "f3_smooth_knee").text(0).split(", unit AS")[0] + " SELECT i, y FROM grid ORDER BY i"
    got = [r.y for r in spark.sql(sql, f3_bins=bins).collect()]
    assert np.allclose(got, np.polynomial.Polynomial.fit(range(40), ys, 7)(np.arange(40)), atol=1e-6)
    rising = spark.createDataFrame([(i, int(100 * (1 - math.exp(-i / 6))), 0.1) for i in range(40)], "i int, y long, wide double")
    assert 8 <= op(fits, "f3_knee")(rising).first().i <= 14 and 5 <= op(fits, "f3_smooth_knee")(rising).first().i <= 16


def test_stratified_draw_by_seed(spark):
    follows = spark.createDataFrame([(f, s) for s in range(300) for f in range(1000, 1000 + 1 + s % 9)], "actor_id long, subject_id long")
    done = spark.createDataFrame([(1,), (2,), (None,)], "subject_id long")
    draw = lambda **k: {(r.subject_id, r.topped_up) for r in op(engagement, "j7_stratified_batch")(follows, done, n=40, **k).collect()}
    one = draw()
    assert one == draw() != draw(seed=7) and 40 <= len(one) <= 44 and not {i for i, _ in one} & {1, 2}


def plain_fire(edges, most, forward, backward, seed):
    mark = lambda *k: hashlib.md5(":".join(map(str, k)).encode()).hexdigest()
    u = lambda *k: (int(mark(*k)[:13], 16) + 0.5) / 2**52
    flag = {True: "true", False: "false"}
    both = {(a, b, True) for a, b in edges if a != b} | {(b, a, False) for a, b in edges if a != b}
    nodes, order, burned, turn, fresh = {a for a, _, _ in both}, [], [], 0, []
    while len(order) < most:
        if not fresh:
            left = nodes - set(order)
            if not left:
                break
            fresh = [min(left, key=lambda n: (mark(seed, n), n))]
        else:
            lit = []
            for n in fresh:
                for ahead, p in ((True, forward), (False, backward)):
                    near = sorted((b for a, b, d in both if a == n and d == ahead and b not in order), key=lambda b: (mark(seed, turn, n, b, flag[ahead]), b))
                    lit += [(n, b, ahead, turn) for b in near[: math.floor(math.log(1 - u(seed, turn, n, flag[ahead])) / math.log(p))]]
            burned += lit
            fresh = sorted({b for _, b, _, _ in lit}, key=lambda b: (min(mark(seed, turn, n, b) for n, c, _, _ in lit if c == b), b))
        order += fresh
        turn += 1
    kept = order[:most]
    return kept, {e for e in burned if e[1] in kept}


def test_forest_fire_equals_plain_python(spark):
    rng = np.random.default_rng(4)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))}
    nodes, lit = forest_fire.burnt(spark.createDataFrame(sorted(edges), "actor_id long, subject_id long"), (10, 40), 0.6, 0.3, 9)
    order, burned = plain_fire(edges, 40, 0.6, 0.3, 9)
    got = sorted((r.place, r.node, r.sample) for r in nodes.collect())
    assert [n for _, n, _ in got] == order and [s for _, _, s in got] == [10] * 10 + [40] * 30
    assert {tuple(r) for r in lit.collect()} == burned
    none = spark.createDataFrame([], "actor_id long, subject_id long")
    assert [x.count() for x in forest_fire.burnt(none)] == [0, 0]


def test_rejected_lines_of_a_dump(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\t\\N\tNULL\td\t5\t0\n\nshort\trow\nb\tr\tv\td\tnoon\t1\nb\tr\tv\td\t99999999999999999999\t1\nb\tr\tv\td\t 7\t1\nb\t\"r\tv\td\t7\t1\textra\n")
    rows = io.read_cascade_tsv(spark, str(tmp_path)).orderBy("time_us").collect()
    assert [(r.subject_uri, r.repost_uri, r.via_uri, r.time_us, r.is_repost) for r in rows] == [("a", None, None, 5, False), ("b", '"r', "v", 7, True)]
    assert {r.reason: r.lines for r in io.rejected_lines(spark, str(tmp_path)).collect()} == {"empty": 1, "short": 1, "time": 2, "time range": 1}


def test_export_has_its_columns(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 3, None, 1.0, 0, 1, 9), ("a", 1, 2, 5, 1.0, 0, 1, 9)], "did string, session_start long, session_end long, next_session_start long, duration_s double, reposts long, posts_authored long, extra long")
    io.export_sessions(df, str(tmp_path / "out"), "s1", io.EXPORT_COLUMNS, "source_table")
    lines = [line for f in sorted((tmp_path / "out").glob("part-*.csv")) for line in f.read_text().split()]
    assert [line for line in lines if not line.startswith("did,")] == ["a,1,2,5,1.0,0,1,s1", "b,2,3,,1.0,0,1,s1"] and lines[0] == "did,session_start,session_end,next_session_start,duration_s,reposts,posts_authored,source_table"


def test_cascades_with_and_without_a_creation(spark):
    posts = spark.createDataFrame([("x", "1", 50)], "did string, rkey string, time_us long")
    p, q = "at://x/app.bsky.feed.post/1", "at://y/app.bsky.feed.post/2"
    records = [("a", "r1", 40, "app.bsky.feed.repost", "create", p, None), ("b", "r2", 60, "app.bsky.feed.repost", "create", p, "at://a/app.bsky.feed.repost/r1"), ("c", "r3", 70, "app.bsky.feed.repost", "delete", p, None), ("c", "r4", 70, "app.bsky.feed.like", "create", p, None), ("d", "r5", 80, "app.bsky.feed.repost", "create", q, None), ("d", "r6", 0, "app.bsky.feed.repost", "create", q, None), ("d", "r7", 5, "app.bsky.feed.repost", "create", None, None)]
    dump = op(cascades, "h1_cascade_dump")(posts, spark.createDataFrame(records, "did string, rkey string, time_us long, collection string, operation string, subject_uri string, via_uri string"))
    first = op(cascades, "h2_dump_parents")(op(cascades, "h1_dump_events")(dump))
    assert {(r.subject_uri, r.idx, r.actor_did, r.pidx) for r in first.collect()} == {(p, 0, "a", None), (p, 1, "x", 0), (p, 2, "b", 0), (q, 0, "d", None)}
    whole = op(cascades, "h2_whole_parents")(op(cascades, "h1_whole_cascades")(dump))
    assert {(r.idx, r.actor_did, r.pidx) for r in whole.collect()} == {(0, "x", None), (1, "a", 0), (2, "b", 1)}
    assert [(r.subject_uri, r.reposts) for r in op(cascades, "h1_orphan_reposts")(dump).collect()] == [(q, 1)]


def test_fits_run_first_in_a_session_of_their_own():
    import subprocess
    import sys

    code = "from pyspark.sql import SparkSession; import __spark_entry__ as e; s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate(); assert e.queries()['g11_fit_gaps'](s, '/root/testdata/sf0.001').count() > 0"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=__file__.rsplit("/", 2)[0])


def plain_density(x, least, neighbours, epsilon):
    """Labels by all pairs: components at every distance, from the widest down, by definition."""
    n = len(x)
    k = min(neighbours, n - 1)
    core = [sorted(abs(a - b) for b in x)[k] for a in x]
    apart = [[max(abs(x[i] - x[j]), core[i], core[j]) for j in range(n)] for i in range(n)]

    def components(members, d):
        """Parts of members linked at distances under d."""
        left, out = set(members), []
        while left:
            part, edge = set(), {min(left)}
            while edge:
                part |= edge
                left -= edge
                edge = {j for j in left if any(apart[i][j] < d for i in edge)}
            out.append(sorted(part))
        return out

    def widest(members):
        """The least distance that links all members: the widest edge of a spanning tree."""
        seen, best = {members[0]}, 0
        near = {j: apart[members[0]][j] for j in members[1:]}
        while near:
            j = min(near, key=near.get)
            best = max(best, near.pop(j))
            near = {i: min(d, apart[i][j]) for i, d in near.items()}
        return best

    clusters = []  # members at birth, density at birth, parent, mass

    def grow(members, c):
        while len(members) > 1:
            d = widest(members)
            big = [p for p in components(members, d) if len(p) >= least]
            kept = sum(map(len, big)) if len(big) == 1 else 0
            clusters[c][3] += (len(members) - kept) * (1 / d - clusters[c][1])
            if len(big) != 1:
                for p in big:
                    clusters.append([p, 1 / d, c, 0.0])
                    grow(p, len(clusters) - 1)
                return
            members = big[0]

    clusters.append([list(range(n)), 0.0, -1, 0.0])
    grow(clusters[0][0], 0)

    def best(c):
        """Mass and clusters of the best choice in and under c."""
        under = [best(k) for k in range(len(clusters)) if clusters[k][2] == c]
        mass, picked = sum(m for m, _ in under), [k for _, ks in under for k in ks]
        return (clusters[c][3], [c]) if c and clusters[c][3] >= mass - 1e-12 * abs(mass) else (mass, picked)

    out = [-1] * n
    for c in best(0)[1]:
        if 1 / clusters[c][1] < epsilon:
            while clusters[c][2] > 0:
                c = clusters[c][2]
                if 1 / clusters[c][1] > epsilon:
                    break
        for i in clusters[c][0]:
            out[i] = c
    return out


def grouping(labels):
    first = {}
    return [-1 if c < 0 else first.setdefault(c, i) for i, c in enumerate(labels)]


@pytest.mark.parametrize("neighbours", [1, 2, 3, 4, 5])
def test_density_labels_equal_all_pairs(neighbours):
    from tidemark.operators.density import core_distances, density_labels

    rng = np.random.default_rng(neighbours)
    seen = set()
    for i in range(120):
        n = int(rng.integers(2, 34))
        centres = rng.integers(0, 4000, int(rng.integers(1, 6)))
        spread = int(rng.choice([10, 90, 700]))
        x = np.unique(rng.choice(centres, n) + rng.integers(0, spread, n)).astype(np.int64)
        least, epsilon = int(rng.integers(2, 6)), float(rng.choice([0, 20, 60, 400]))
        k = min(neighbours, len(x) - 1)
        assert core_distances(x, neighbours).tolist() == [sorted(abs(x - a))[k] for a in x]
        got = grouping(density_labels(x, least, neighbours, epsilon))
        assert got == grouping(plain_density(x.tolist(), least, neighbours, epsilon)), (i, x.tolist(), least, epsilon)
        seen.add(len(set(got)))
    assert len(seen) > 3


def test_density_of_a_heavy_user_and_odd_rows(spark):
    from tidemark.operators.density import density_labels, density_sessions

    steps = np.random.default_rng(1).pareto(1.2, 200_000) * 1e6
    labels = density_labels(np.unique(np.cumsum(steps).astype(np.int64)), 2, 3, 6e7)
    assert len(set(labels)) > 100
    rows = [(None, 5), (None, 7), ("a", None), ("a", 0), ("a", 0), ("a", 1_000_000), ("a", 900_000_000), ("a", 901_000_000), ("b", None)]
    out = density_sessions(spark.createDataFrame(rows, "did string, time_us long")).orderBy("session_start").collect()
    assert [(r.did, r.session_start, r.session_end) for r in out] == [("a", 0, 1_000_000), ("a", 900_000_000, 901_000_000)]
    assert density_sessions(spark.createDataFrame([], "did string, time_us long")).count() == 0
