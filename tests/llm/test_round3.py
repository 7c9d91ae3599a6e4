"""Divergence audit, subspace join and centroids against plain Python, on the given tables and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import centroids, divergence, html_text, matroska, sharding, subspace

SF = "/root/testdata/sf0.001"


def plain_audit(rows, top=200):
    """(lang, source, part, item, value, rank) by the definition."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in words:
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    kept = {lang: {t for t, n in c.items() if n >= 3} for lang, c in docs.items()}
    counts = {g: Counter({t: n for t, n in c.items() if t in kept[g[0]]}) for g, c in groups.items()}
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)
    share = lambda c, t, lang: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept[lang]))
    shares = {g: {t: share(c, t, g[0]) for t in kept[g[0]]} for g, c in counts.items()}
    out = set()
    for g, p in shares.items():
        pairs = [(-sum((p[t] - q) ** 2 // q for t, q in shares[h].items()), h[1].encode(), h[1]) for h in shares if h[0] == g[0] and h != g]
        out |= {(*g, "pair", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(pairs))}
        terms = [(-((p[t] - q) ** 2 // q), t.encode(), t) for t in counts[g] if p[t] > (q := share(whole[g[0]], t, g[0]))]
        out |= {(*g, "term", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(terms)[:top])}
    return out


ODD = [
    (1, "Ärger Zebra zebra ab-c x1y", "de", "a"), (2, "ärger ZEBRA\x00ab", "de", "a"), (3, "zebra Ärger ab Ärger", "de", "b"), (3, "zebra Ärger ab Ärger", "de", "b"), (4, None, "de", "c"), (5, "", None, None),
    (6, "one one one " * 5000, "en", "a"), (7, "one two", "en", "b"), (8, "one two \U0001f600", "en", "b"), (9, "\U0001f600 two one �", "en", None), (10, "123 --", "xx", "s"), (11, "!", "xx", "t"), (None, "one \U0001f600", "en", ""),
]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], []])
def test_audit_of_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS term", "'x' AS n")
    got = [tuple(r) for r in divergence.audited(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows)


def test_audit_cuts_ties_in_utf8_order(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 7)
    rows = [(i, f"w{chr(97 + i % 20)}  common w{chr(97 + i % 20)}", "en", f"s{i % 2}") for i in range(200)]
    got = {tuple(r) for r in divergence.audited(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), top=5).collect()}
    assert got == plain_audit(rows, 5) and sum(r[2] == "term" for r in got) == 10


def test_audit_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    assert {tuple(r) for r in divergence.audited(docs).collect()} == plain_audit([tuple(r) for r in docs.collect()])


def plain_links(vectors, least=0.95):
    """id -> (links, component) by all pairs; ids differ."""
    ids = [i for i, _ in vectors]
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in vectors]
    n, near = len(ids), defaultdict(set)
    for a in range(n):
        for b in range(a):
            if good[a] and good[b] and len(vectors[a][1]) == len(vectors[b][1]):
                x, y = (np.array(vectors[k][1], float) / max(map(abs, vectors[k][1])) for k in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    near[ids[a]].add(ids[b])
                    near[ids[b]].add(ids[a])
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        out[i] = (len(near[i]), min(seen))
    return out


def clumps(rng, dims, sizes, spread):
    for n in sizes:
        centre = rng.standard_normal(dims)
        for _ in range(n):
            yield (centre + rng.standard_normal(dims) * spread * np.linalg.norm(centre) / math.sqrt(dims)).tolist()


@pytest.mark.parametrize("tile", [16384, 40])
def test_subspace_join_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(subspace, "TILE", tile)
    rng = np.random.default_rng(5)
    # Around the threshold: a spread of 0.22 gives cosines on both sides of 0.95.
    rows = [*clumps(rng, 64, [60, 40, 25], 0.22), *clumps(rng, 64, [30, 20], 0.05), *clumps(rng, 64, [1] * 60, 0), *clumps(rng, 3, [30, 5], 0.3), *clumps(rng, 1, [3], 0), *clumps(rng, 2, [40], 1)]
    rows += [rows[0], rows[0], [x * 3 for x in rows[1]], [x * 1e-200 for x in rows[2]], None, [], [0.0] * 64, [math.nan] * 64, [math.inf] + [1.0] * 63, [None] + [1.0] * 63]
    vectors = list(zip(rng.permutation(len(rows)).tolist(), rows, strict=True))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS key", "2 AS u").repartition(3)
    got = subspace.near_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_links(vectors) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_subspace_join_of_nulls_repeats_and_nothing(spark):
    rows = [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in subspace.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True)], key=str)
    assert subspace.near_vectors(df.limit(0)).collect() == []


def test_subspace_join_in_passes_equals_all_pairs(spark, monkeypatch):
    for name, value in (("TILE", 25), ("SMALL_TILE", 25), ("MOVED", 1)):
        monkeypatch.setattr(subspace, name, value)
    folds, summed, dealt, passes = [], subspace.summed, [], subspace.passes
    monkeypatch.setattr(subspace, "summed", lambda found: folds.append(len(found)) or summed(found))
    monkeypatch.setattr(subspace, "passes", lambda tiles, rows: dealt.append((passes(tiles, rows), tiles, rows)) or dealt[-1][0])
    rng = np.random.default_rng(6)
    rows = [*clumps(rng, 64, [100], 0.05), *clumps(rng, 64, [20], 0.22), *clumps(rng, 64, [1] * 30, 0)]
    vectors = list(zip(rng.permutation(len(rows)).tolist(), rows, strict=True))
    got = subspace.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_links(vectors) and len(got) == len(rows)
    (groups, of), tiles, n = dealt[0]
    moved = [r.rows for r in groups.join(tiles, "tile").groupBy("pass").agg({"rows": "sum"}).toDF("pass", "rows").collect()]
    assert of >= 3 and max(moved) < 5 * n < sum(moved) + 2 * n and len(folds) >= 2


def plain_centroids(vectors, k=40, rounds=5):
    kept = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)}
    mark = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    cs = [kept[i] for i in sorted(kept, key=mark)[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    place = lambda: {i: min((far(v, c), j) for j, c in enumerate(cs)) for i, v in kept.items()}
    for _ in range(rounds):
        at = place()
        for j in range(len(cs)):
            if own := [kept[i] for i, (_, n) in at.items() if n == j]:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = place()
    spent = Counter()
    for d, j in at.values():
        spent[j] += d
    return {(i, j, d, spent[j], sum(spent.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, (d, j) in at.items()}


@pytest.mark.parametrize("n", [300, 7, 0])
def test_centroids_equal_plain_python(spark, n):
    rng = np.random.default_rng(n)
    odd = [(900, None), (901, [0.5] * 63), (902, [math.nan] * 64), (903, [math.inf] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [])] + ([(906, [1000.0] * 64), (907, [-1000.0] * 64), (908, [0.0] * 64), (909, [0.0] * 64)] if n else [])
    vectors = [(i, (rng.standard_normal(64) * rng.choice([0.01, 0.2, 5])).tolist()) for i in range(n)] + odd
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS planes").repartition(3)
    got = [tuple(r) for r in centroids.clustered(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_centroids(vectors)


def test_planes_are_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**k), 2**k, (50, 64)) for k in (26, 9))
    a[0], b[0] = -(2**26), 2**9 - 1
    assert (centroids.numbers(centroids.planes(a)) == a).all() and (centroids.dots(centroids.planes(a), centroids.planes(b)) == a @ b.T).all()
    assert (centroids.squares(centroids.planes(a)) == (a * a).sum(1)).all()


def test_damaged_media_never_end_a_job():
    rng = np.random.default_rng(8)
    whole = [matroska.mux(rng.bytes(64 * n)) for n in (1, 9, 40)]
    cells = []
    for i in range(10_000):
        cell = bytearray(whole[i % 3])
        for at in rng.integers(0, min(len(cell), 400), rng.integers(1, 4)):
            cell[at] = rng.integers(0, 256)
        cells.append(bytes(cell))
    cells += [None, b"", b"\x1a\x45\xdf\xa3", rng.bytes(500)]
    told = matroska.tables(cells)
    assert {len(x) for x in told} == {len(cells)} and set(told[4].to_pylist()) == {None, "truncated", "not Matroska", "number out of range"}
    assert [x.to_pylist() for x in matroska.tables(whole)[:1]] == [[matroska.tables([w])[0][0].as_py() for w in whole]]


@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "visitor_comments", "alert", "site-alert"])
def test_comments_and_alerts_by_compound_names(spark, name):
    body = "".join(f"<p>Paragraph {i} of the story, which says a good deal, and then some more.</p>" for i in range(6))
    aside = "<p>I do not agree at all, said a reader, at some length, and twice.</p>" * 3
    html = [f"<html><body><article>{body}<div class='{name}'>{aside}</div></article></body></html>", f"<html><body class='has-alert user-page'><article>{body}</article><div id='{name}'>{aside}</div></body></html>"]
    rows = html_text.extracted(spark.createDataFrame([(i, "http://x", h) for i, h in enumerate(html)], "page_id long, url string, html string")).collect()
    want = " ".join(f"Paragraph {i} of the story, which says a good deal, and then some more." for i in range(6))
    assert [r.text for r in rows] == [want, want]


@pytest.mark.parametrize("part", [64, 1 << 16])
def test_equal_rows_are_dealt_over_all_shards(spark, monkeypatch, part):
    monkeypatch.setattr(sharding, "COPIES", part)
    rows = spark.range(20000).selectExpr("CAST(7 AS BIGINT) AS doc_id", "'the same text' AS text").unionByName(spark.createDataFrame([(None, None)] * 700 + [(7, "ä"), (8, ""), (8, None)], "doc_id long, text string"))
    got = sharding.sharded(rows).toPandas()
    load, counts = got.groupby("shard")["size"].sum(), Counter(zip(got.doc_id.fillna(-1), got["size"], strict=True))
    assert counts == {(7, 14): 20000, (-1, 1): 700, (7, 3): 1, (8, 1): 2}
    assert set(load.index) == set(range(16)) and load.max() - load.min() <= 0.01 * load.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, sharding.sharded(rows.repartition(5)).toPandas().values.tolist()))
