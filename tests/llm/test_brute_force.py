"""Numbered operators against brute force and hand-made cases."""

import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import chat, html_text, matroska, packing, simhash, toxicity, urls
from tidemark.llm import sentencepiece_codec as sp

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\x00").replace("\u00a0", "\x01")
    words = [w for w in __import__("re").split(r"[ \t-\r]+", words) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(900, None), (901, "Two words"), (902, "  "), (903, "one"), (904, "A b C d"), (905, "a B c D")]
    want = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in want}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(want)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (want[a] ^ want[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (f"{want[i]:016x}", find(i)) for i in want}
    assert simhash.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingler_tells_runs_apart_and_counts_common_ones(spark):
    s = simhash.Shingler(5)
    assert len(s.hashes("a b c d e".encode())) == len(s.hashes(b"A  b\tc d E ")) == len(s.hashes(b"a b c d")) == 1
    assert s.hashes(b"a b c d e")[0] == s.hashes(b" A b\nc d e")[0] != s.hashes(b"a b c e d")[0]
    assert len(s.hashes(b"")) == len(s.hashes(None)) == len(s.hashes(b" \n")) == 0
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(300)) for _ in range(20)]
    for t in texts:
        w = t.split()
        assert len(s.hashes(t.encode())) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    docs = spark.createDataFrame([(i, "the same five words here " + t) for i, t in enumerate(texts)], "doc_id long, text string")
    levels = simhash.common_cells(docs, 5)
    assert levels[simhash._cell(s.hashes(b"the same five words here"))[0]] >= 2 and (levels > 0).sum() < 20 * 300


def test_reputation_equals_plain_python(spark):
    rng = random.Random(2)
    hosts = {f"h{i}.d{i % 7}.{'com' if i % 7 < 4 else 'org'}": (n := rng.randrange(0, 90), rng.randrange(0, n + 1) if i % 3 else n) for i in range(40)}
    hosts |= {"a.b.co.uk": (20, 19), "u@c.b.co.uk:80": (3, 0), "": (2, 1)}

    def strength(groups):
        groups = [g for g in groups if g[0]]
        a, b = sum(m * (1 - m) for _, _, m in groups), sum(m * (1 - m) * (n - 1) for n, _, m in groups)
        return 1 / min(0.5, max(1e-4, (sum((k - n * m) ** 2 / n for n, k, m in groups) - a) / b)) - 1

    def domain(h):
        name = h.split("@")[-1].split(":")[0].split(".")
        return ".".join(name[-3:] if ".".join(name[-2:]) in urls.TWO_PART_SUFFIXES else name[-2:])

    up = {h: (domain(h), domain(h).partition(".")[2]) for h in hosts}
    of = lambda level: {k: (sum(hosts[h][0] for h in hosts if up[h][level] == k), sum(hosts[h][1] for h in hosts if up[h][level] == k)) for k in {u[level] for u in up.values()}}
    root = sum(k for _, k in hosts.values()) / sum(n for n, _ in hosts.values())
    suffixes = of(1)
    s1 = strength([(*v, root) for v in suffixes.values()])
    m1 = {x: (k + s1 * root) / (n + s1) for x, (n, k) in suffixes.items()}
    domains, over = of(0), {d: s for d, s in up.values()}
    s2 = strength([(*v, m1[over[d]]) for d, v in domains.items()])
    m2 = {d: (k + s2 * m1[over[d]]) / (n + s2) for d, (n, k) in domains.items()}
    s3 = strength([(*v, m2[up[h][0]]) for h, v in hosts.items()])
    draws = np.random.default_rng(1)
    got = {r.host: r for r in urls.reputation(spark.createDataFrame([(h, n, k) for h, (n, k) in hosts.items()], "host string, n long, k long")).collect()}
    assert set(got) == set(hosts)
    for h, (n, k) in hosts.items():
        rate = (k + s3 * m2[up[h][0]]) / (n + s3)
        assert got[h].bad_rate == pytest.approx(rate, abs=1e-9) and got[h].n_labelled == n and got[h].n_bad == k
        low = np.quantile(draws.beta((n + s3) * rate, (n + s3) * (1 - rate), 200_000), 0.05)
        assert got[h].bad_low == pytest.approx(low, abs=0.004)
    assert got["a.b.co.uk"].suffix_strength == pytest.approx(s1) and got["a.b.co.uk"].domain_strength == pytest.approx(s2)


def test_a_bad_host_is_blocked_by_its_posterior(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good'}{i % 3}.{'evil' if i < 60 else 'fine'}.io/x/{i}", "x", 1) for i in range(200)] + [(200, "http://new.evil.io/about", "x", 1), (200, "http://new.evil.io/about", "x", 1)], "page_id long, url string, html string, host int")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in urls.judged_pages(pages, labels).collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(60, 200)} == {"allow"} and got[200] == "block"
    assert urls.judged_pages(pages, labels).count() == 202 and urls.judged_pages(pages.limit(0), labels).count() == 0
    assert urls.judged_pages(pages.limit(5), labels.limit(0)).where("verdict = 'allow'").count() == 5


BODY = [f"The {w} sentence of the story, which is told at some length; it goes on, and ends." for w in "first second third fourth fifth sixth seventh eighth".split()]
LINKS = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12))
LAYOUTS = {
    "plain divs": "<div><div>{links}</div><div>{body}</div><div>{links}</div></div>",
    "table": "<table><tr><td><ul>{links}</ul></td><td>{body}</td></tr></table>",
    "sections": "<section><ul>{links}</ul></section><section>{body}</section>",
    "deep": "<div><div><div><div>{links}</div><div><div>{body}</div></div></div></div></div>",
    "links last": "<div>{body}</div><div><ul>{links}</ul></div>",
    "center": "<center>{body}</center><div>{links}</div>",
    "unclosed": "<div><ul>{links}</ul></div><div>{body}",
    "main": "<div>{links}</div><main>{body}</main><div>{links}</div>",
    "nested lists": "<div><ul><li><ul>{links}</ul></li></ul></div><div><div>{body}</div></div>",
    "odd tags": "<x-menu>{links}</x-menu><div><x-story>{body}</x-story></div>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_paths_choose_the_content_without_names(layout):
    page = "<html><body>" + LAYOUTS[layout].format(body="".join(f"<p>{x}</p>" for x in BODY), links=LINKS) + "</body></html>"
    assert html_text.main_text(page) == " ".join(BODY)


def test_the_threshold_decides():
    page = "<html><body>" + LAYOUTS["plain divs"].format(body="".join(f"<p>{x}</p>" for x in BODY), links=LINKS) + "</body></html>"
    scores = html_text.path_scores(p := html_text.read(page), [b for b in p.blocks if not b[2]])
    assert sorted(x >= html_text.LEAST * max(scores.values()) for x in scores.values()) == [False, True]


def test_deep_and_odd_pages(spark):
    assert html_text.main_text("<div>" * 20000 + "A text, here." + "</b>" * 20000) == "A text, here."
    pages = spark.createDataFrame([(1, "u", None, "t", "x"), (1, "u", None, "t", "x"), (2, None, "", None, "y"), (3, "u", "<p>Yes, so it is.", "t", "z")], "page_id long, url string, html string, TEXT string, `a.b` string")
    got = html_text.main_texts(pages)
    assert got.columns == ["page_id", "url", "a.b", "text"] and [r.text for r in got.orderBy("page_id").collect()] == ["", "", "", "Yes, so it is."]
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_many_clusters_of_unknown_size():
    unknown = lambda ident, body: ident.to_bytes((ident.bit_length() + 7) // 8, "big") + b"\x01" + b"\xff" * 7 + body
    block = lambda i: matroska.element(matroska.SIMPLE_BLOCK, b"\x81\0\0\x80" + struct.pack(">I", i))
    clusters = b"".join(unknown(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, i) + block(i)) for i in range(5000))
    cell = matroska.HEADER + unknown(matroska.SEGMENT, matroska.TRACK_TABLE + clusters + matroska.element(matroska.CUES, b""))
    packets, _, error = matroska.parse(cell)
    assert error is None and [(p[1], p[4]) for p in packets] == [(i, i * 1_000_000) for i in range(5000)]
    packets, _, error = matroska.parse(cell[:-8])
    assert error == "truncated" and len(packets) == 4999


def test_packing_of_odd_rows(spark):
    rows = [(None, "a b c")] * 3 + [(None, "d e f"), (1, "x y"), (1, "x y"), (2, None), (3, "z " * 5000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, bucket int")
    got = packing.packed(docs, buckets=2, budget=16).toPandas()
    assert len(got) == len(rows) and Counter(got.n_tokens) == {3: 4, 2: 2, 0: 1, 5000: 1}
    assert not got.duplicated(["bucket", "batch", "slot"]).any() and set(got.bound) == {3, 5000} and (got.padding == got.bound - got.n_tokens).all()
    assert packing.bucket_table(spark.range(9000, 9003).withColumnRenamed("id", "n_tokens"), buckets=3) == [(9000, 1), (9001, 1), (9002, 1)]
    # Equal lengths under null ids are dealt by their texts.
    many = spark.range(2000).selectExpr("cast(null as long) doc_id", "cast(id as string) text")
    assert packing.packed(many, budget=8).groupBy("batch").count().where("count > 8").isEmpty()


def test_turns_that_repeat_and_no_turns(spark):
    turns = [(1, 0, "u", "a", "z"), (1, 0, "u", "a", "z"), (2, 0, "u", "a", "z"), (3, None, "u", "b", "z"), (3, 2, None, "c", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, place string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chat.collapse_and_render(df).collect()}
    assert got == {1: (2, 1, "<|u|>\na<|end|>\n" * 2), 3: (2, 1, "<|u|>\nb<|end|>\n<||>\nc<|end|>\n")}
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_pieces_follow_their_probabilities(spark):
    codec = sp.Codec.load().built()
    scores = [s for _, s, k in codec.pieces if k == "normal"]
    assert abs(sum(map(np.exp, scores)) - 1) < 1e-9
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang = 'en'").limit(60).collect()]
    own, merged = sum(len(codec.encode(t)) for t in texts), sum(len(model.encode(t)) for t in texts)
    assert own < 1.05 * merged
    assert sp.tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "you fool " * 30000, 0.5), (4, "you fool", 0.5), (4, "you fool", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 0), (4, 1), (4, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and toxicity.judged(docs.limit(0), labels).count() == 0
    assert toxicity.training_rows(docs, labels, labels.doc_id > 0).count() == 3


def plain_scores(texts, training):
    """Scores by sets of n-gram strings, counts and a dense logistic fit; training: (toxic, text)."""

    def grams(text):
        padded = " " + " ".join((text or "").lower().split()) + " "
        return {padded[i : i + n] for n in (3, 4, 5, 6) for i in range(len(padded) - n + 1) if " " not in padded[i + 1 : i + n - 1]}

    sets, y = [grams(t) for _, t in training], np.array([float(bool(x)) for x, _ in training])
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    toxic, clean = Counter(), Counter()
    for s, label in zip(sets, y, strict=True):
        (toxic if label else clean).update(s)
    ratios = {}
    for g in set(toxic) | set(clean):
        p, q = toxic[g], clean[g]
        pooled = (p + q) / (n1 + n0)
        z = abs(p / n1 - q / n0) / max(pooled * (1 - pooled), 1e-12) ** 0.5 / (1 / n1 + 1 / n0) ** 0.5
        if p + q >= 3 and z >= 5:
            ratios[g] = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    names = sorted(ratios)
    scaled = lambda s: np.array([ratios[g] if g in s else 0.0 for g in names])
    x = np.column_stack([np.array([scaled(s) for s in sets]), np.ones(len(y))])
    w, m, v, penalty = np.zeros(len(names) + 1), 0.0, 0.0, np.append(np.full(len(names), 1e-4), 0)
    for t in range(1, 401):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return len(names), [1 / (1 + np.exp(-(scaled(grams(t)) @ w[:-1] + w[-1]))) for t in texts]


def test_toxicity_equals_plain_python(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    toxic, least = {}, {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and not held(r.doc_id):
            toxic[r.doc_id] = max(r.toxic, toxic.get(r.doc_id, r.toxic))
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        if r.doc_id in toxic and r.text is not None:
            least[r.doc_id] = min(r.text, least.get(r.doc_id, r.text))
    width, want = plain_scores([r.text for r in rows], [(toxic[i], least.get(i)) for i in toxic if any(r.doc_id == i for r in rows)])
    assert width > 10
    got = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    assert len(got) == len(rows)
    for r, score in zip(rows, want, strict=True):
        assert abs(got[r.doc_id].score - score) < 1e-6 and got[r.doc_id].held_out == held(r.doc_id)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
