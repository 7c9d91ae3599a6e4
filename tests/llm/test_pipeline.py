"""The pipeline's stages against plain Python, and on odd rows and names."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from tidemark.llm import packing, quality, toxicity

SF = "/root/testdata/sf0.001"


def plain_quality(text):
    """Whether a text passes, by the rules as the ledger states them."""
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(runs)
    inside = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(3)}
    n, chars = len(words), sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return not (n < 50 or 100 * len(inside) > 50 * n or 20 * symbols > chars or 2 * (len(lines) - len(set(lines))) > len(lines) or chars > 12 * n or chars < 2 * n)


def plain_groups(rows):
    """Least row of each group of near copies, over rows in order of id: texts with a similarity of 0.8 or more on five words."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, least = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        return i if least[i] == i else find(least[i])

    for a, b in combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            least[y] = x
    return [i for i in range(len(rows)) if find(i) == i]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages_equal_plain_python(spark, stages):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(s.columns == given.columns for s in stages[:3])
    rows = given.collect()
    kept = [r for r in rows if plain_quality(r.text)]
    assert {r.doc_id for r in stages[0].collect()} == {r.doc_id for r in kept}
    model = toxicity.trained(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    lookup = model.lookup()
    clean = sorted((r.doc_id, r.text) for r in kept if toxicity.score(r.text, model, lookup) < 0.7)
    assert sorted((r.doc_id, r.text) for r in stages[1].collect()) == clean
    left = [clean[i][0] for i in plain_groups(clean)]
    assert sorted(r.doc_id for r in stages[2].collect()) == left
    lengths = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text)) for r in kept}
    packed = stages[3].toPandas()
    assert sorted(packed.doc_id) == left and all(lengths[r.doc_id] == r.n_tokens <= r.bound for r in packed.itertuples())
    assert not packed.duplicated(["bucket", "batch", "slot"]).any()
    assert (packed.groupby(["bucket", "batch"]).bound.agg(lambda x: x.sum()) <= max(packing.BUDGET, packed.bound.max())).all()


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[3].collect()))


def test_clashing_names_and_odd_rows_pass_through(spark):
    rng = random.Random(9)
    text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(80))
    other = " ".join(f"term{rng.randrange(10**6)}" for _ in range(80))
    names = ["doc_id", "text", "n_words", "fail_bits", "_n", "_row", "row", "score", "node", "same", "a.b", "told", "_words"]
    rows = [(None, text), (3, text), (3, text), (None, other), (None, other), (5, None), (6, ""), (7, other + " more")]
    docs = spark.createDataFrame([(i, t, "mine", 5, 6, "r", "q", 0.25, "n", "s", "d", "t", "w") for i, t in rows], ", ".join(f"`{n}` {k}" for n, k in zip(names, "long string string int int string string double string string string string string".split(), strict=True)))
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == names and docs.count() == {"quality_rules": 6, "toxicity": 6, "simhash_near_dedup": 2}[name]
        assert {tuple(r)[2:] for r in docs.collect()} == {tuple(before.first())[2:]}
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(3, text), (7, other + " more")]
    assert corpus_pipeline.length_packing(spark, docs, SF).count() == 2 and corpus_pipeline.length_packing(spark, docs.limit(0), SF).count() == 0


def test_ledger_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, _n string, N_WORDS int")
    got = quality.ledger(docs)
    assert got.columns == ["doc_id", "_n", *quality.MEASURES, "fail_bits"] and got.first().n_words == 2
    assert quality.ledger(docs.select("text")).first().n_words == 2
