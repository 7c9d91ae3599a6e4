"""What operators keep on disk: shuffle files and written tables go once they are read; what would move at once moves in slices."""

import random
from itertools import combinations
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tidemark.llm import _common, simhash


@pytest.fixture
def shared(spark):
    """The tables that a test leaves under spark.checkpoint.dir."""
    _common.set_checkpoint_dir(spark)
    top = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = {*top.iterdir()}
    return lambda: {p: pq.read_schema(next(p.glob("*.parquet"))).names for p in {*top.iterdir()} - before}


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, kept = shuffle_files(spark), spark.conf.get(_common.CLEANUP)
    table, _ = _common.written(spark.range(20_000).groupBy("id").count())
    assert not shuffle_files(spark) - before and spark.conf.get(_common.CLEANUP) == kept
    assert table.count() == 20_000


@pytest.mark.parametrize("least", [10**9, 1])
def test_near_duplicates_in_slices_equal_brute_force(spark, shared, monkeypatch, least):
    for name in ("SHINGLES", "LISTED", "PAIRS"):
        monkeypatch.setattr(simhash, name, least)
    monkeypatch.setattr(simhash, "SLICES", 3)
    monkeypatch.setattr(simhash, "MOST_SENT", 1 if least == 1 else 200_000)
    rng, texts = random.Random(11), []
    for _ in range(12):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(5):
            texts.append(text)
            text = [f"c{rng.randrange(10**6)}" if rng.random() < rng.choice((0.005, 0.02, 0.05)) else w for w in text]
    sets, least_of = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts], list(range(len(texts)))
    find = lambda i: i if least_of[i] == i else find(least_of[i])
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            least_of[y] = x
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.group_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(i, find(i)) for i in range(len(texts)) if find(i) != i} and got
    assert not [names for names in shared().values() if {"prefix", "shared", "of", "x"} & {*names}]
