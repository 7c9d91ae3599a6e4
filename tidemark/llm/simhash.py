"""SimHash near-duplicates found through anchor points of a covering code.

A fingerprint has 64 bits. Two fingerprints within ``max_bits`` differ by one bit at most in one of
``blocks = max_bits // 2 + 1`` blocks (pigeonhole), so each block has its own anchors for threshold one. The anchors of a
block of w bits are the words of a perfect Hamming code on its first 2^r - 1 bits (covering radius one), joined with every
setting of the w - 2^r + 1 bits that remain (radius nought). A fingerprint has one home anchor, the nearest. It is
replicated to every anchor within covering radius plus threshold: its home, the other code words at distance two, and its
home with one of the remaining bits turned. Homes meet replicas in one equi-join on the anchor. Replicas per fingerprint
depend on the code alone (34 for three bits), never on the data; equal fingerprints are merged before they are replicated.

Nulls and odd input: a null or blank text has no words and the fingerprint zero, linked like any other; a null id keeps its
row, and a group's id is the least that is not null; repeated rows stay rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import columns, deleted, small_batches, written

SEED = 42
#: Of the polynomials that hash words and shingles; odd.
BASE, STEP = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
#: Cells in which shingles are counted: 2^CELL_BITS. Nodes that are broadcast at most. Rounds of comparing with heads.
CELL_BITS, MOST_SENT, ROUNDS = 20, 200_000, 3
#: What would take several times the disk of the texts in one shuffle moves a slice at a time: shingles, shingles with what tells of their rows, or pairs of a slice, and slices at most.
SHINGLES, LISTED, PAIRS, SLICES = 4_000_000, 1_000_000, 100_000, 8


def in_slices(rows: DataFrame, key: str | Column, n: int, most: int) -> list[DataFrame]:
    """rows, of which n make the shuffle, dealt by key into tables of most of these, but SLICES at most."""
    of = max(1, min(SLICES, math.ceil(n / most)))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(of)) == k) for k in range(of)] if of > 1 else [rows]


def one_table(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def settled(df: DataFrame) -> DataFrame:
    """df as a written table. A checkpoint would hand the planner what it knows of df's columns, which doubles with each join of a loop."""
    return written(df)[0]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of that many lower-cased words; of the whole sequence if it is shorter."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """A bit is set if it is set in over half the shingles' hashes. Signed, as Spark's long."""
    hashes = shingle_hashes(text or b"", words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): the 64-bit SimHash of each whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _masks(width: int) -> list[tuple[int, int, bool]]:
    """(syndrome, mask, home): block ^ mask is each anchor to which a block with that syndrome goes."""
    r = (width + 1).bit_length() - 1
    n = 2**r - 1
    out = []
    for s in range(2**r):
        flip = 1 << (s - 1) if s else 0
        out.append((s, flip, True))
        out += [(s, 1 << (i - 1) | 1 << ((i ^ s) - 1), False) for i in range(1, n + 1) if s and i < i ^ s]
        out += [(s, flip | 1 << bit, False) for bit in range(n, width)]
    return out


def anchored(spark: SparkSession, fps: DataFrame, max_bits: int) -> DataFrame:
    """(anchor, home, fp) for each of the distinct fingerprints of fps. The table of masks depends on the code alone: under 1,100 rows."""
    blocks = _blocks(max_bits)
    signed = lambda m: m - 2**64 if m >> 63 else m
    masks = spark.createDataFrame([(k, s, signed(m), home) for k, (_, w) in enumerate(blocks) for s, m, home in _masks(w)], "block int, syndrome int, mask long, home boolean")
    parts = []
    for k, (first, width) in enumerate(blocks):
        r = (width + 1).bit_length() - 1
        checks = [sum(1 << (p - 1) for p in range(1, 2**r) if p >> j & 1) for j in range(r)]
        low = F.col("fp") if width == 64 else F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(2**width - 1))
        syndrome = sum((F.shiftleft(F.bit_count(low.bitwiseAND(F.lit(c))) % 2, j) for j, c in enumerate(checks)), F.lit(0))
        parts.append(F.struct(F.lit(k).alias("block"), syndrome.cast("int").alias("syndrome"), low.alias("low")))
    sides = fps.select("fp", F.explode(F.array(*parts)).alias("side")).select("fp", "side.*")
    return sides.join(F.broadcast(masks), ["block", "syndrome"]).select("block", F.col("low").bitwiseXOR(F.col("mask")).alias("anchor"), "home", "fp")


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints in column fp that differ in max_bits bits at most, once."""
    spread = anchored(fps.sparkSession, fps.select("fp").distinct(), max_bits)
    homes = spread.where("home").select("block", "anchor", F.col("fp").alias("a"))
    copies = spread.select("block", "anchor", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    pairs = homes.join(copies, ["block", "anchor"]).where(near)
    return pairs.select("a", "b").distinct()


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, component) of each node that the edges (a, b) touch; component is its least node.

    Every round hooks each node to its first neighbour, shortens the trees by a few pointer jumps, and contracts them. First
    is by a hash of the node: in a chain of rising nodes these runs are short, so rounds grow as the logarithm of the chain.
    Minima combine before the shuffle. What is joined on a node or component that many rows share is written before, so
    that both sides are plain shuffles and adaptive execution splits the large one.
    """
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    left, left_path = written(edges.select("a", "b").where("a <> b"))
    assigned, assigned_path, rows = None, None, left.count()
    while rows:
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        met = both.groupBy(F.col("e.a").alias("node")).agg(F.min(F.struct(F.xxhash64("e.b").alias("h"), F.col("e.b").alias("n"))).alias("m"))
        up, gone = written(met.select("node", F.least(first("node"), "m")["n"].alias("up")))
        for _ in range(jumps):
            up = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))
        up, up_path = written(up, gone)
        if assigned is None:
            assigned, assigned_path = written(up.select("node", F.col("up").alias("component")))
        else:
            then = up.select(F.col("node").alias("component"), "up")
            assigned, assigned_path = written(assigned.join(then, "component", "left").select("node", F.coalesce("up", "component").alias("component")), assigned_path)
        ends = left
        for end in ("a", "b"):
            ends = ends.join(up.select(F.col("node").alias(end), F.col("up").alias(f"{end}2")), end)
        left, left_path = written(ends.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), left_path, up_path)
        rows = left.count()
    deleted(edges.sparkSession, left_path)
    if assigned is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    least = settled(assigned.groupBy("component").agg(F.min("node").alias("least")))
    return assigned.join(least, "component").select("node", F.col("least").alias("component"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """(id_col, fp, component_id): component_id is the least id whose fingerprint can be reached through links."""
    return _grouped(settled(fingerprints(docs, id_col, text_col, words)), id_col, max_bits)


def sorted_side(df: DataFrame) -> DataFrame:
    """df for a join on a key that no row repeats: both sides grow with the documents, so they are sorted, not sent through the driver."""
    return df.hint("merge")


def _grouped(marks: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """marks (id_col, fp) with component_id.

    Many rows may share a fingerprint, and many fingerprints a component: the tables of one row each are written before
    they are joined to those, for the reason given at ``components``.
    """
    least = settled(marks.groupBy("fp").agg(F.min(id_col).alias("own")))
    linked = settled(components(links(least, max_bits)).select(F.col("node").alias("fp"), "component").join(sorted_side(least), "fp"))
    named = settled(linked.groupBy("component").agg(F.min("own").alias("group_id")))
    groups = settled(sorted_side(least).join(linked.join(named, "component").select("fp", "group_id"), "fp", "left").select("fp", F.coalesce("group_id", "own").alias("component_id")))
    return marks.join(groups, "fp").select(id_col, "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The digest of op4."""
    groups = simhash_components(docs)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


class Shingler:
    """Distinct hashes of the runs of some lower-cased words of a text; of the whole sequence if it is shorter; none of a blank text.

    A word's hash is a polynomial of its bytes, taken from running sums over the text; a run's is a polynomial of its words'.
    """

    def __init__(self, words: int) -> None:
        self.words, self.space = words, np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = 2 * n + 1
            self.power, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(size, m, np.uint64))) for m in (BASE, pow(BASE, -1, 2**64)))

    def hashes(self, text: bytes | None) -> np.ndarray:
        """Unsigned, rising."""
        raw = text or b""
        raw = raw.lower() if raw.isascii() else raw.decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape")
        c = np.frombuffer(raw, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], self.space[c], [True]))))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, np.uint64)
        self._grow(len(c))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * self.power[: len(c)])))
        word = _mixed((sums[ends] - sums[starts]) * self.inverse[starts])
        width = min(self.words, len(word))
        run = word[: len(word) - width + 1]
        for k in range(1, width):
            run = run * np.uint64(STEP) + word[k : len(word) - width + 1 + k]
        return np.unique(_mixed(run))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit spread over the whole number; no two numbers become one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def common_cells(docs: DataFrame, words: int) -> np.ndarray:
    """For each of 2^CELL_BITS cells of hashes, the binary logarithm of how many times the mean number of shingles fall in it; 0 under four times.

    All documents count, each shingle once in each. A task tells only of cells over twice its own mean, so it sends few rows;
    a cell over four times the mean of all is over that in the tasks that hold most of it. So a shingle in over about a 500th
    of the documents is told from the others, however many there are.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sums = Shingler(words), np.zeros(2**CELL_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(sums, _cell(shingler.hashes(text)), 1)
        total = sums.sum()
        cells = np.flatnonzero(sums > 2 * total / len(sums))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *cells], pa.int32()), pa.array([total, *sums[cells]], pa.int64())], ["cell", "n"])

    small_batches(docs.sparkSession)
    counts = settled(docs.select(F.col("text").cast("binary")).mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    total = counts.where("cell = -1").first()
    mean = (total.n if total else 0) / 2**CELL_BITS
    often, levels = counts.where((F.col("cell") >= 0) & (F.col("n") >= 4 * mean)).toArrow(), np.zeros(2**CELL_BITS, np.uint8)
    levels[often["cell"].to_numpy()] = np.log2(often["n"].to_numpy() / (mean or 1)).astype(np.uint8)
    return levels


#: Longs that hold, for each of 256 values, whether an odd number of a set's hashes end in it.
ODD = ["odd0", "odd1", "odd2", "odd3"]


def _features(docs: DataFrame, words: int) -> DataFrame:
    """(node, fp, same, n, prefix, ODD) of docs (node, text): same is equal for equal sets of n shingles. Two sets with a Jaccard similarity of 0.8 or more share one of their prefixes' shingles.

    A prefix is the first n - ceil(0.8 n) + 1 shingles of the set in an order that holds for all documents: shingles of
    common cells last, then by hash. The order settles only how many candidates there are, not what is found.
    """
    small_batches(docs.sparkSession)
    levels = common_cells(docs, words)
    kind = docs.schema["node"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            fps, same, sizes, prefixes, odd = [], [], [], [], np.empty((4, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = shingler.hashes(text)
                n = len(found)
                odd[:, i] = np.packbits(np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64)
                fps.append(fingerprint(text))
                same.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(n)
                order = np.argsort(levels[_cell(found)], kind="stable")
                prefixes.append(found[order[: n - (4 * n + 4) // 5 + 1]].view(np.int64))
            columns = [batch.column(0), pa.array(fps, pa.int64()), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), *map(pa.array, odd)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "fp", "same", "n", "prefix", *ODD])

    rows = docs.select("node", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(hashed, f"node {kind}, fp long, same binary, n int, prefix array<long>, odd0 long, odd1 long, odd2 long, odd3 long")


def few_or_many(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with keys, one row per key: by a broadcast if they are MOST_SENT at most, else by a shuffle of rows."""
    keys = settled(keys)
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_SENT else keys, key, how)


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int = 5, least: float = 0.8, bits: int = 32) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts' sets of shingles have a Jaccard similarity of ``least`` or more.

    nodes: (row, node); docs: (node, text), one row a node. Sets meet as that many bits, 16 or 32, of each hash. What those share,
    and the hashes that fall together, are no fewer than what the sets share, so no pair is lost; with 32 bits a pair of sets of
    a thousand shingles is taken for more alike than it is by one shingle in some thousands of pairs.
    """
    pairs, pairs_path = written(pairs)
    n = pairs.count()
    ends = [pairs.select(F.col(end).alias("row")).distinct() for end in ("a", "b")]
    wanted = ends[0].union(ends[1]).distinct().join(sorted_side(nodes), "row")
    unsigned, signed, kind = (np.uint16, np.int16, "smallint") if bits == 16 else (np.uint32, np.int32, "int")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = [shingler.hashes(t) for t in batch.column(1).to_pylist()]
            sets = [np.unique((h >> np.uint64(64 - bits)).astype(unsigned)).view(signed) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in found], pa.int32()), pa.array(sets, pa.list_(pa.from_numpy_dtype(signed)))], ["row", "n", "of"])

    # Few rows are sent to the texts; else the texts move.
    wanted, wanted_path = written(wanted)
    whole, rows = docs.select("node", F.col("text").cast("binary").alias("text")), wanted.count()
    sent = rows <= MOST_SENT
    made = []
    for some, few in zip(*(in_slices(x, "node", 0 if sent else rows, MOST_SENT) for x in (whole, wanted)), strict=True):
        texts = some.join(F.broadcast(few) if sent else few, "node").select("row", "text")
        made.append(written(texts.mapInArrow(hashed, f"row long, n int, of array<{kind}>")))
    sets = one_table([x for x, _ in made])
    shared = F.size(F.array_intersect("x.of", "y.of")) + F.least(F.col("x.n") - F.size("x.of"), F.col("y.n") - F.size("y.of"))
    found, parts = [], in_slices(pairs, F.struct("a", "b"), n, PAIRS)
    for both in parts:
        for end, x in (("a", "x"), ("b", "y")):
            own = sets if len(parts) == 1 else few_or_many(sets, both.select(F.col(end).alias("row")).distinct(), "row", "left_semi")
            both = both.join(own.select(F.col("row").alias(end), F.struct("n", "of").alias(x)), end)
        found.append(settled(both.where(shared >= least * (F.col("x.n") + F.col("y.n") - shared)).select("a", "b")))
    deleted(docs.sparkSession, pairs_path, wanted_path, *(path for _, path in made))
    return one_table(found)


def shared_shingles(sets: DataFrame, sets_path: str) -> tuple[DataFrame, str, int]:
    """(row, n, ODD, shared) of the written table sets (row, n, prefix, ODD), which is deleted, as a written table, its folder, and how many shingles it lists: shared lists (s, place), each shingle of the prefix that another row's prefix has too, and its place in its own.

    Which shingles are shared is counted before the rows meet them, so that a shingle in very many rows is a plain join on one row, which adaptive execution splits.
    """
    rows, made = sets.select("row", F.posexplode("prefix").alias("place", "s")), []
    for own in in_slices(rows, "s", sets.agg(F.sum(F.size("prefix"))).first()[0] or 0, SHINGLES):
        more, gone = written(own.groupBy("s").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi").select("s"))
        made.append(written(own.join(more, "s").groupBy("row").agg(F.collect_list(F.struct("s", "place")).alias("shared")), gone))
    about, about_path = written(sets.select("row", "n", *ODD), sets_path)
    of = one_table([x for x, _ in made])
    if len(made) > 1:
        of = of.groupBy("row").agg(F.flatten(F.collect_list("shared")).alias("shared"))
    met, path = written(of.join(sorted_side(about), "row").select("row", "n", *ODD, "shared"), about_path, *(x for _, x in made))
    return met, path, met.agg(F.sum(F.size("shared"))).first()[0] or 0


def _turned(x: str, y: str) -> Column:
    """Bits of ODD in which two sets differ."""
    return sum((F.bit_count(F.col(f"{x}.{o}").bitwiseXOR(F.col(f"{y}.{o}"))) for o in ODD), F.lit(0))


def _can_meet(x: str, y: str) -> Column:
    """Whether two sets, each a struct of n and ODD, may have a similarity of 0.8: they then differ in a ninth of their sizes' sum at most, and each difference turns one bit of ODD."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (9 * _turned(x, y) <= both) & (9 * F.least(f"{x}.n", f"{y}.n") >= 4 * both)


def _first_can_be(x: str, y: str) -> Column:
    """Whether two sets of a similarity of 0.8 may share, as their first in the order of prefixes, the shingle at these places: what follows it in either is then enough."""
    rest = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
    return 9 * rest >= 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _summed(rows: DataFrame) -> DataFrame:
    """Of each pair (a, b) and shingles that their prefixes share: how many these are, and what follows the last of them in either."""
    return rows.groupBy("a", "b").agg(F.min("both").alias("both"), F.sum("shared").alias("shared"), F.min("rest_a").alias("rest_a"), F.min("rest_b").alias("rest_b"))


def _sharing(pairs: DataFrame) -> DataFrame:
    """(a, b, both, shared, rest_a, rest_b) of pairs (x, y), each (row, n, place) of one shingle in two prefixes."""
    rows = pairs.select(F.col("x.row").alias("a"), F.col("y.row").alias("b"), (F.col("x.n") + F.col("y.n")).alias("both"), (F.col("x.n") - F.col("x.place")).alias("rest_a"), (F.col("y.n") - F.col("y.place")).alias("rest_b"))
    return _summed(rows.withColumn("shared", F.lit(1).cast("long")))


def _reaching(met: DataFrame) -> DataFrame:
    """(a, b) of what ``_summed`` tells of whole prefixes: those that can reach a similarity of 0.8.

    What two sets share of their prefixes, and what is left of them after the last of it, must be enough for that. Shared
    shingles that ``_first_can_be`` leaves out follow the others, so they are among what is left.
    """
    return met.where("9 * (shared - 1 + least(rest_a, rest_b)) >= 4 * both").select("a", "b")


def _place(label: str, size: str, seed: int) -> Column:
    """The place of a label of so many rows among all: larger ones first, equal ones by hash."""
    return F.struct((-F.col(size)).alias("size"), F.xxhash64(label, F.lit(seed)).alias("h"))


def _sized(labels: DataFrame) -> DataFrame:
    """labels (row, label) with size, the number of rows of the label; only labels of several rows are joined."""
    sizes = settled(labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    return settled(labels.join(sizes, "label", "left").select("row", "label", F.coalesce("size", F.lit(1)).alias("size")))


def hubs(rows: DataFrame, seed: int, n: int = 0) -> DataFrame:
    """(a, b): for a row b, of the rows of other labels that head one of its shingles and may be similar, that which differs in the least bits of ODD.

    rows: those of ``_listed``, about n of them. A shingle is headed by a row, another for each shingle, of the label that comes first as of
    ``_place``, so that labels have few partners and rows may choose among many. Most rows first: what is still apart from a
    large label meets that, not the large label's rows one of what is apart.
    """
    own = ["row", "n", *ODD]
    first = F.struct(_place("label", "size", seed).alias("h"), "label", F.xxhash64("row", "s", F.lit(seed)).alias("k"), *own)
    made = []
    for some in in_slices(rows, "s", n, LISTED):
        heads, gone = written(some.groupBy("s").agg(F.min(first).alias("x"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("s", "x"))
        pairs = some.select("s", "label", F.struct(*own).alias("y")).join(heads, "s").where((F.col("label") != F.col("x.label")) & _can_meet("x", "y"))
        made.append(written(pairs.groupBy(F.col("y.row").alias("b")).agg(F.min(F.struct(_turned("x", "y").alias("turned"), F.col("x.row").alias("a"))).alias("m")), gone))
    best = one_table([x for x, _ in made])
    if len(made) > 1:
        best = best.groupBy("b").agg(F.min("m").alias("m"))
    return written(best.select("m.a", "b"), *(x for _, x in made))[0]


def merged(labels: DataFrame, found: DataFrame, seed: int, jumps: int = 2) -> DataFrame:
    """labels (row, label, size) after the labels that the pairs found (a, b) of ``hubs`` join are made one, but for chains longer than the jumps settle.

    A label goes to one that comes before it as of ``_place``, so there are no rings; labels that stay apart only cost comparisons.
    """
    pairs = found.join(labels.select(F.col("row").alias("a"), F.col("label").alias("to"), "size"), "a").join(labels.select(F.col("row").alias("b"), F.col("label").alias("of")), "b")
    up = settled(pairs.groupBy("of").agg(F.min(F.struct(_place("to", "size", seed).alias("h"), "to")).alias("m")).select(F.col("of").alias("label"), F.col("m.to").alias("up")))
    for _ in range(jumps):
        then = up.select(F.col("label").alias("up"), F.col("up").alias("top"))
        up = settled(up.join(then, "up", "left").select("label", F.coalesce("top", "up").alias("up")))
    return _sized(settled(labels.join(up, "label", "left").select("row", F.coalesce("up", "label").alias("label"))))


def candidates(rows: DataFrame, n: int = 0) -> DataFrame:
    """(a, b) of each pair of rows of unlike labels whose sets can reach a similarity of 0.8.

    rows: those of ``_listed``, about n of them. What cannot reach it is left out in the join itself, by size, by place and by bits, so
    pairs are written for texts that are alike, or are long, and not yet of one label.
    """
    one, made = F.struct("row", "n", "place", *ODD), []
    for some in in_slices(rows, "s", n, LISTED):
        both = some.select("s", "label", one.alias("x")).join(some.select("s", F.col("label").alias("label_b"), one.alias("y")), "s")
        made.append(written(_sharing(both.where((F.col("label") < F.col("label_b")) & _first_can_be("x", "y") & _can_meet("x", "y")))))
    met = one_table([x for x, _ in made])
    return written(_reaching(_summed(met) if len(made) > 1 else met), *(x for _, x in made))[0]


def _labelled(met: DataFrame, labels: DataFrame, path: str) -> tuple[DataFrame, str]:
    """The rows of ``shared_shingles`` with label and size, written in place of those of path: lists move, not their shingles one by one."""
    return written(met.select("row", "n", *ODD, "shared").join(sorted_side(labels), "row"), path)


def _listed(met: DataFrame) -> DataFrame:
    """(s, place, row, n, ODD, label, size) of the rows of ``_labelled``."""
    return met.select("row", "n", *ODD, "label", "size", F.inline("shared"))


def _near(docs: DataFrame, words: int) -> DataFrame:
    """(node, component) over docs (node, text), which repeat no node: components of the pairs whose sets of shingles have a similarity of 0.8 or more.

    Each such pair is found, or its texts are joined by others. Equal sets count once. Fingerprints within three bits are
    joined through anchors, and each member that is similar to its component's head is labelled by it. Rows that share a
    shingle of their prefixes are then compared with a head of these, one a row, and labels so joined become one, in ROUNDS
    rounds, so that a large group of near copies is mostly of one label. Last, all sets of unlike labels that share such a
    shingle are compared. A component is named by its least node.
    """
    # Numbers of rows are short keys; the table settles them.
    marks, marks_path = written(_features(docs, words).withColumn("row", F.monotonically_increasing_id()))
    sets = settled(marks.groupBy("same").agg(F.min(F.struct("row", "node", "fp", "n")).alias("m")).select("same", "m.*"))
    nodes = sets.select("row", "node")
    prefixes, prefixes_path = written(sorted_side(marks.select("row", "n", "prefix", *ODD)).join(sets.select("row"), "row"))
    marks, _ = written(marks.select("row", "node", "same"), marks_path)
    heads = _grouped(sets.select("row", "fp"), "row", 3)
    links = similar(heads.where("row <> component_id").select(F.col("component_id").alias("a"), F.col("row").alias("b")), nodes, docs, words)
    labels = _sized(settled(sorted_side(sets.select("row")).join(links.select(F.col("b").alias("row"), F.col("a").alias("head")), "row", "left").select("row", F.coalesce("head", "row").alias("label"))))
    met, met_path, n = shared_shingles(prefixes, prefixes_path)
    for seed in range(ROUNDS):
        met, met_path = _labelled(met, labels, met_path)
        found = similar(hubs(_listed(met), seed, n), nodes, docs, words)
        links, labels = links.unionByName(found), merged(labels, found, seed)
    # Sixteen bits leave few pairs that aren't alike, so whole sets of few texts move.
    met, met_path = _labelled(met, labels, met_path)
    maybe = similar(candidates(_listed(met), n), nodes, docs, words, bits=16)
    deleted(docs.sparkSession, met_path)
    alike = similar(maybe, nodes, docs, words)
    copies = marks.select(F.col("row").alias("a"), "same").join(sets.select("same", F.col("row").alias("b")), "same").where("a <> b").select("a", "b")
    joined = components(copies.unionByName(links).unionByName(alike).distinct())
    named = settled(joined.select(F.col("node").alias("row"), "component").join(sorted_side(marks.select("row", "node")), "row"))
    least = settled(named.groupBy("component").agg(F.min("node").alias("least")))
    return named.join(least, "component").select("node", F.col("least").alias("component"))


def _noded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with node, of id and text: a null id is an id after all others."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.withColumn("node", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("told")))


def _repeats(noded: DataFrame) -> DataFrame:
    """Nodes that more than one row has."""
    return settled(noded.groupBy("node").count().where("count > 1").select("node"))


def _once(noded: DataFrame, again: DataFrame) -> DataFrame:
    """noded with one row for each node; only rows of the nodes of again move, and combine before they do."""
    if again.isEmpty():
        return noded
    others = [c for c in noded.columns if c != "node"]
    one = few_or_many(noded, again, "node", "left_semi").groupBy("node").agg(F.first(F.struct(*others)).alias("o")).select("node", "o.*")
    return few_or_many(noded, again, "node", "left_anti").unionByName(one)


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, group_id) of every text that isn't the one to keep of its group of near copies, that of the least id.

    A group is a component as of ``_near``. Repeated rows, of one id and text, are one; a null id counts as the greatest.
    """
    noded = _noded(docs.select("doc_id", "text"), "doc_id", "text").select("node", "text")
    joined = _near(_once(noded, _repeats(noded)), words)
    return joined.where("node <> component").select(F.col("node.id").alias("doc_id"), F.col("component.id").alias("group_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs without near copies: of each group as of ``near_duplicates`` the text of the least id stays, in one row."""
    noded = _noded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*columns(docs)).alias("row")), "id", "text")
    again = _repeats(noded)
    gone = _near(_once(noded.select("node", "text"), again), words).where("node <> component").select("node")
    rest = few_or_many(noded.select("node", "row"), gone, "node", "left_anti")
    return _once(rest, again).select("row.*")
