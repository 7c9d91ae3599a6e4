"""Reports against plain Python over their inputs, where twins are the same statement."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.plans.registry import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    made = {}
    return lambda name: CATALOG.frame(spark, SF, name, made).toPandas().replace({np.nan: None})


def shares(counts):
    total = sum(counts.values())
    return {k: (n, round(100 * n / total, 6)) for k, n in counts.items()}


def near(a, b, digits=5e-6):
    return (a is None and b is None) or abs(float(a) - float(b)) <= digits


def test_events_of_active_users(rows):
    lo, hi = 1704067200000000, 1706659200000000
    want = [(r.did, r.time_us, r.collection.removeprefix("app.bsky.").replace(".", "_")) for r in rows("records").itertuples() if r.operation == "create" and r.collection.startswith("app.bsky.") and lo <= r.time_us < hi]
    want += [(r.did, r.time_us, "post_top" if r.reply_root_uri is None else "post_reply") for r in rows("posts").itertuples() if lo <= r.time_us < hi]
    per = Counter(did for did, _, _ in want)
    assert Counter((r.did, r.time_us, r.event_type) for r in rows("b2_all_events").itertuples()) == Counter(x for x in want if per[x[0]] >= 8)


def test_types_users_and_overlap(rows):
    ev = rows("ev")
    assert {r.event_type: (r.n, r.pct) for r in rows("b9_type_breakdown").itertuples()} == shares(Counter(ev.event_type))
    assert {r.events: r.users for r in rows("c6_events_per_user").itertuples()} == Counter(Counter(ev.did).values())
    a, b = set(rows("records").did), set(rows("posts").did)
    got = rows("c5_user_overlap").iloc[0]
    assert (got.a, got.b, got.either, got.a_only, got.b_only) == (len(a), len(b), len(a | b), len(a - b), len(b - a))
    days = Counter((s, t // 86_400_000_000) for s, name in (("records", "records"), ("posts", "posts")) for t in rows(name).time_us)
    assert {(r.source, r.day): r.n for r in rows("c3_events_per_day").itertuples()} == days


def test_chances_of_one_type_given_another(rows):
    posts = rows("i2_post_engagement")
    got = {(r.type, r.given): r.p for r in rows("i8_conditional_probs").itertuples()}
    assert len(got) == 6
    for (a, b), p in got.items():
        of, both = posts[f"n_{b}"] > 0, (posts[f"n_{a}"] > 0) & (posts[f"n_{b}"] > 0)
        assert near(p, both.sum() / of.sum() if of.sum() else None)


def test_transitions(rows):
    acts = defaultdict(list)
    for r in rows("i1_engagement_events").itertuples():
        acts[r.k].append((r.time_us, r.event_id, r.type))
    want = Counter((a[2], b[2]) for x in acts.values() if len(x) >= 3 for a, b in zip(sorted(x), sorted(x)[1:], strict=False))
    of = Counter()
    for (a, _), n in want.items():
        of[a] += n
    got = {(r.type, r.next): (r.n, r.p) for r in rows("i7_transition_matrix").itertuples()}
    assert got.keys() == want.keys() and all(n == want[k] and near(p, n / of[k[0]]) for k, (n, p) in got.items())


def test_degrees_and_buckets(rows):
    follows = rows("follows")
    ins, outs = Counter(follows.subject_id), Counter(follows.actor_id)
    nodes = sorted(ins.keys() | outs.keys())
    i, o = [ins[x] for x in nodes], [outs[x] for x in nodes]
    got = rows("j5_degree_stats").iloc[0]
    assert (got.nodes, got.edges, got.in_most, got.out_most) == (len(nodes), len(follows), max(i), max(o))
    assert near(got.in_median, np.median(i)) and near(got.out_median, np.median(o)) and near(got.in_mean, np.mean(i)) and near(got.density, len(follows) / len(nodes))
    buckets = shares(Counter(math.frexp(ins[c])[1] - 1 if ins[c] else -1 for c in rows("customer").c_custkey))
    assert {r.bucket: (r.users, r.pct) for r in rows("j6_follower_buckets").itertuples()} == buckets


def test_parameters_of_the_best_fits(rows):
    fitted = rows("g11_fit_gaps")
    params = {"alpha": "alpha", "xmin": "xmin", "rate": "rate", "meanlog": "meanlog", "sdlog": "sdlog"}
    seen = 0
    for r in rows("g13_param_summary").itertuples():
        if r.param in params:
            x = [float(v) for v in fitted[fitted.best == r.best][params[r.param]] if v is not None]
            assert r.users == len(x)
            if len(x) > 1:
                seen += 1
                assert near(r.mean, np.mean(x), 1e-4) and near(r.median, np.median(x), 2e-6 + 1e-12 * abs(np.median(x))) and near(r.sd, np.std(x, ddof=1), 1e-4)
    assert seen
    assert {r.best: (r.users, r.pct) for r in rows("g12_best_fit_breakdown").itertuples()} == shares(Counter(fitted.best))
    best, gaps = dict(zip(fitted.did, fitted.best, strict=True)), defaultdict(list)
    for r in rows("d1_gaps").itertuples():
        if r.did in best and r.gap is not None and r.gap > 0:
            gaps[best[r.did]].append(r.gap / 1e6)
    got = {r.best: (r.n, r.median_s) for r in rows("g16_gap_by_best_fit").itertuples()}
    assert got.keys() == gaps.keys() and all(n == len(gaps[k]) and near(m, np.median(gaps[k])) for k, (n, m) in got.items())


def test_percentiles_of_parameters(rows):
    weibull, got = rows("g8_weibull_fits"), rows("g14_param_percentiles").iloc[0]
    assert got.n == len(weibull)
    for c in ("shape", "scale"):
        x = weibull[c].dropna().astype(float)
        assert all(near(got[f"{c}_p{p}"], np.percentile(x, p), 2e-6) for p in (1, 5, 25, 50, 75, 95, 99))
