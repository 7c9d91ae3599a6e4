"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import pandas as pd
import pytest

from tidemark.llm import chat, html_text, matroska, packing, quality, sharding, simhash, toxicity, urls
from tidemark.llm import sentencepiece_codec as sp
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "é ▁ \u0000 x"), (4, "é ▁ \u0000 x"), (5, "word " * 30000), (6, "One two three four five")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in ODD], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = lambda df: sorted(repr([None if pd.isna(v) else str(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_quality_of_odd_rows(odd):
    got = {r.doc_id: r for r in quality.judged(odd).collect()}
    assert got[1].n_words == 0 and got[1].fail_bits == 1 and not got[1].kept
    assert got[5].n_words == got[5].n_repeat_words == 30000 and got[5].base_failed
    assert quality.judged(odd.limit(0)).count() == 0
    few = {r.rule: (r.n_fail, r.n_only) for r in quality.ablation(quality.ledger(odd)).collect()}
    assert few["few_words"][0] == 7 and few["repeated_phrases"] == (1, 1)


def test_simhash_links_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    points = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4, 5, 6, 7)} | {0, 2**64 - 1, 7}
    signed = [p - 2**64 if p >> 63 else p for p in points]
    for bits in (1, 3, 7):
        want = {tuple(sorted((a, b))) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
        assert {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(200, 201)], "a long, b long")
    assert Counter(r.component for r in simhash.components(edges).collect()) == {0: 21, 200: 2}


def test_simhash_of_odd_rows(odd):
    got = {r.doc_id: r for r in simhash.digest(odd).collect()}
    assert got[1].fingerprint == "0" * 16 and {got[i].component_id for i in (1, 2, 3)} == {1}
    assert simhash.fingerprint(b"A  b") == simhash.fingerprint(b"a b")


def test_near_copies_stay_once(spark):
    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = [*text[:200], "changed", *text[201:]]
    other = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(text)), (4, " ".join(other))], "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect()} == {2, 3}


def test_best_bounds_equal_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        cells = sorted((x, rng.randrange(1, 9)) for x in rng.sample(range(60), rng.randrange(1, 9)))
        cost = lambda bounds: sum(c * min(b for b in bounds if b >= max(1, x)) for x, c in cells)
        tops = sorted({max(1, x) for x, _ in cells})
        for k in (1, 2, 3):
            want = min(cost((*p, tops[-1])) for n in range(k) for p in combinations(tops[:-1], n))
            assert cost(packing.best_bounds(cells, k)) == want


def test_packing_fills_batches(spark, odd):
    got = packing.packed(odd, budget=64).toPandas()
    assert len(got) == len(ODD) and (got.n_tokens <= got.bound).all() and not got.duplicated(["bucket", "batch", "slot"]).any()
    assert packing.packed(odd.limit(0)).count() == 0


def test_shards_are_even_and_gapless(spark):
    got = QUERIES["op6_virtual_slots"](spark, SF).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    load = got.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(16)) and load.max() - load.min() < 0.005 * load.mean() and set(got.map_version) == {2}
    assert not got.doc_id.duplicated().any() and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for r in got.merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id").itertuples():
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    sizes = {s: (1, s % 7 + 1) for s in range(512)}
    old = sharding.rebalanced(sharding.first_map(4, 512), sizes, 4, 0.001)
    new = sharding.rebalanced(old, sizes, 5)
    load = Counter()
    for s, k in new.items():
        load[k] += sizes[s][1]
    assert max(load.values()) - min(load.values()) < 0.1 * max(load.values()) and sum(old[s] != new[s] for s in old) < 160


def test_maps_are_stored_once_a_version(spark, tmp_path, odd):
    path = str(tmp_path / "maps")
    for k in (1, 1, 2):
        sharding.write_map(sharding.map_table(spark, sharding.first_map(k, 64), {0: (3, 9)}, k), path)
    assert sharding.read_map(spark, path).count() == sharding.read_map(spark, path, 1).count() == 64 and sharding.read_map(spark, path, 0).count() == 0
    assert {r.shard for r in sharding.read_map(spark, path).collect()} == {0, 1} and sharding.read_map(spark, path).first().version == 2
    got = sharding.sharded(odd, 2, 64, store=path).toPandas()
    assert len(got) == len(ODD) and set(got.map_version) == {3} and got["size"].tolist().count(1) == 2
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.sharded(odd.limit(0)).count() == 0


def test_matroska_round_trip_and_damage(spark, odd):
    for r, (i, t) in zip(matroska.media_digest(odd).collect(), ODD, strict=True):
        raw = (t or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    media = matroska.mux(bytes(range(256)) * 100)
    packets, cues, error = matroska.parse(media)
    assert error is None and b"".join(media[p[7] : p[7] + p[8]] for p in packets) == bytes(range(256)) * 100 and len(cues) == 1
    assert matroska.parse(media[: len(media) // 2])[2] == "truncated" and matroska.parse(b"junk")[2] == "not Matroska"
    for kind, head in ((1, b"\x81\0\0\x82\x02\xff\x01\x02"), (3, b"\x81\0\0\x86\x02\x41\x00\x60\x02")):
        block = matroska.element(matroska.SIMPLE_BLOCK, head + bytes(600))
        cell = matroska.HEADER + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 0) + block))
        sizes = [p[8] for p in matroska.parse(cell)[0]]
        assert sizes == ([256, 2, 342] if kind == 1 else [256, 259, 85])


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a>m</a></nav><div class='sidebar x'>side</div><article><h1>He&amp;ad</h1><p>One  <b>two</b>.<p>Three<br>four<script>no</script><div id=comments>c</div></article><footer>f</footer>"
    assert html_text.main_text(page) == "He&ad One two. Three four"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("<body><div id=menu>m</div><div class=text><p>A long story, told well.</p><p>End.</p></div>") == "A long story, told well. End."


def test_sentencepiece_best_path_and_round_trip(spark, odd):
    codec = sp.Codec.load().built()
    scores = {p: s for p, s, k in codec.pieces if k == "normal"}
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("the an  é☃▁\n") for _ in range(rng.randrange(1, 14)))
        s = f" {text}".replace("▁", "\0").replace(" ", "▁")
        best = [0.0] + [float("-inf")] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = max([best[e - n] + scores[s[e - n : e]] for n in range(1, min(e, 20) + 1) if s[e - n : e] in scores] + ([] if s[e - 1] in codec.singles else [best[e - 1] + codec.fallback]))
        ids, total, run = codec.encode(text), 0.0, 0
        for i in ids:
            total += codec.pieces[i][1] if codec.pieces[i][2] == "normal" else 0
        unknown = sum(c not in codec.singles for c in s)
        assert abs(total + unknown * codec.fallback - best[-1]) <= 1e-6 * abs(best[-1])
        assert sp._decoded(ids, codec.surfaces()) == text
    got = {r.doc_id: r for r in sp.tokens(odd).collect()}
    assert got[1].ids is None and all(r.round_trip for r in got.values())


def test_toxicity_learns(spark):
    rng = random.Random(4)
    words = [f"wor{a}{b}" for a in "abcdef" for b in "ghijkl"]
    rows = [(i, " ".join(rng.choices(words, k=40) + (["you", "blargh"] if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    assert all(got[i].predicted == y for i, _, y in rows if got[i].held_out)
    assert toxicity.judged(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/7?x"), (2, "x"), (3, None), (4, "http://b.org/es/1"), (5, "http://bcom/en/")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged_pages(pages, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {1: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("b.org", "/es/1", "org/es/", "block"), 5: ("bcom", "/en/", None, "allow")}
    bad = spark.createDataFrame([("x.a.com", 200, 200), ("y.a.com", 200, 0), ("z.b.com", 0, 0)], "host string, n long, k long")
    rate = {r.host: r for r in urls.reputation(bad).collect()}
    assert rate["x.a.com"].bad_low > 0.9 > 0.1 > rate["y.a.com"].bad_rate and 0.2 < rate["z.b.com"].bad_rate < 0.8


def test_chat_collapse(spark):
    turns = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "b", "x"), (3, 0, "u", "a"), (3, 1, "b", "x"), (4, 0, "u", None), (None, 0, "u", "z")]
    got = {r.conv_id: r for r in chat.collapse_and_render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 4, None} and got[2].n_copies == 2 and got[2].chat == "<|u|>\na<|end|>\n<|b|>\nx<|end|>\n"
    long = spark.range(3000).selectExpr("1L conv_id", "id turn", "'u' role", "cast(id as string) text")
    assert sorted((r.piece, r.n_turns) for r in chat.collapse_and_render(long).collect()) == [(0, 3000), (1, 3000), (2, 3000)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 120))]
        texts.append(text)
        for _ in range(4):  # edits in a chain, many of them beyond seven bits or under 0.8
            text = [f"c{rng.randrange(10**6)}" if rng.random() < rng.choice((0.005, 0.02, 0.05)) else w for w in text]
            texts.append(text)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]

    def shingles(t):
        return {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}

    sets, least = [shingles(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if least[i] == i else find(least[i])
    wide = 0
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            wide += ((simhash.fingerprint(docs[a][1].encode()) ^ simhash.fingerprint(docs[b][1].encode())) & (2**64 - 1)).bit_count() > 7
            x, y = sorted((find(a), find(b)))
            least[y] = x
    want = {(i, find(i)) for i in range(len(texts)) if find(i) != i}
    assert wide and {(r.doc_id, r.group_id) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_what_is_apart_from_a_large_label_joins_it_at_once(spark):
    labels = spark.range(80).selectExpr("id AS row", "IF(id < 50, 0L, id) AS label", "IF(id < 50, 50L, 1L) AS size")
    rows = labels.selectExpr("*", "100 AS n", *(f"0L AS {o}" for o in simhash.ODD), "explode(sequence(1L, 40L)) AS s")
    for seed in range(simhash.ROUNDS):
        found = simhash.hubs(rows, seed)
        assert {(r.a < 50, r.b) for r in found.collect()} == {(True, b) for b in range(50, 80)}
        assert {tuple(r) for r in simhash.merged(labels, found, seed).collect()} == {(i, 0, 80) for i in range(80)}


def test_near_duplicates_of_odd_rows(odd):
    assert {(r.doc_id, r.group_id) for r in simhash.near_duplicates(odd).collect()} == {(2, 1), (3, 1)}


def test_near_fingerprints_of_unlike_texts_stay(spark):
    rng = random.Random(11)
    refrain = [f"w{rng.randrange(10**6)}" for _ in range(21)] * 80  # it settles the fingerprints, but little of the sets
    text, other = ([*refrain, *(f"{c}{rng.randrange(10**6)}" for _ in range(40))] for c in "uv")
    a, b = " ".join(text), " ".join(other)
    assert ((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())) & (2**64 - 1)).bit_count() <= 3
    near = " ".join([*other, "more"])  # like the second text, not like the head
    docs = spark.createDataFrame([(1, a), (2, b), (3, near)], "doc_id long, text string")
    assert {(r.doc_id, r.group_id) for r in simhash.near_duplicates(docs).collect()} == {(3, 2)}


def test_html_keeps_all_of_the_content(spark):
    long = "A sentence of the story, told in some words. " * 7
    parts = ["<ul>" + "<li>short item</li>" * 10 + "</ul>", "<ul><li><a href=x>linked item</a></li></ul>", "<table><tr><td>cell one<td>cell two</table>", "<blockquote>So it is.</blockquote>", "<p>Yes.</p>"]
    for name in ("article", "div"):
        for part in parts:
            body = f"<h1>Head</h1>{f'<p>{long}</p>' * 6}{part}{f'<p>{long}</p>' * 6}"
            want = " ".join(html_text.re.sub("<[^>]*>", " ", body).split())
            assert html_text.main_text(f"<body><nav>n</nav><div class=sidebar>s</div><{name}>{body}</{name}></body>") == want


def test_html_names_do_not_hide_the_page(spark):
    text = " ".join(["One sentence, then one more."] * 9)
    for page in ("<body class='has-sidebar'><p>{}</p></body>", "<main class='content with-comments'><p>{}</p></main>", "<article class='post share-enabled'><p>{}</p></article>", "<body class='sidebar'><p>{}</p></body>", "<div class='no-comments'><p>{}</p></div>"):
        assert html_text.main_text(page.format(text)) == text
    for name in ("ad", "site-footer", "cookie_notice", "related-posts"):
        assert html_text.main_text(f"<article><p>{text}</p><div class='x {name}'>junk</div></article>") == text
    teaser = "<article><p>A teaser, short.</p></article>"
    assert text in html_text.main_text(f"<body><div><p>{text}</p><p>{text}</p></div>{teaser}</body>")


def test_matroska_times_of_laced_frames_and_tracks(spark):
    packets, _, _ = matroska.parse(matroska.mux(bytes(512 * 20 + 64)))
    assert [p[4] for p in packets] == [64_000_000 * k for k in range(21)]
    tracks = matroska.parse_all(matroska.mux(bytes(64)))[3]
    assert tracks == [(1, 1, "audio", "A_PCM/INT/LIT", 64_000_000, 8000.0, 1, 8)]
    block = matroska.element(matroska.BLOCK, b"\x81\0\0\x04\x03" + bytes(40))
    group = matroska.element(matroska.BLOCK_GROUP, block + matroska.number(matroska.BLOCK_DURATION, 80))
    cluster = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 5) + group)
    for table, step in ((b"", 20), (matroska.TRACK_TABLE, 64)):
        for parts in (table + cluster, cluster + table):
            cell = matroska.HEADER + matroska.element(matroska.SEGMENT, parts)
            assert [p[4] for p in matroska.parse(cell)[0]] == [(5 + step * k) * 1_000_000 for k in range(4)]
    media = spark.createDataFrame([(1, matroska.mux(bytes(64)))], "doc_id long, media binary")
    assert [t.codec for t in matroska.demuxed(media).first().tracks] == ["A_PCM/INT/LIT"]
