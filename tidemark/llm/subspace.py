"""Embedding near-duplicates by a join of tiles in a subspace.

Unit vectors with a cosine of ``least`` or more have a squared distance of ``2 - 2 least`` at most, in any subspace too.
Vectors are rotated by a fixed random rotation, so that no component matters more than others. Space is cut into cells, as wide
as that distance, by the first two components, so near vectors are in one cell or in cells side by side. The rows of a
cell are dealt into tiles, and every two tiles of such cells are one group, so no task holds a hot cell. Inside a group, pairs
within the distance in the first components are found by products of small matrices and verified exactly. No pair leaves the
group: it tells, for each vector, how many it is linked with, and a head of those linked here.

A vector is in as many groups as there are tiles near its own, and these grow with the vectors. So groups are dealt to passes,
in each of which a vector moves about twice, as it was given, and a pass's shuffle is deleted before the next. What passes tell is
summed up whenever it outgrows the vectors. So disk grows with the vectors, also where thousands are near each other, and time as
their square where they are spread evenly.

Equal vectors count once, with their number. Cosines are in doubles, of the rotated unit vectors, which differ from those of
the given ones by less than 1e-14. Vectors that are null, empty, zero, or hold a null or non-finite component link with
nothing, nor do vectors of unlike lengths. A null id is never the smallest; repeated rows are copies; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import small_batches, written
from tidemark.llm.simhash import components

LEAST = 0.95
#: Rows of a tile at most and at least, and the tiles aimed at between; rows that a pass may always move; the narrowest cell.
TILE, SMALL_TILE, TILES, MOVED, NARROW = 32768, 512, 16, 500_000, 0.1
#: Components that the products take; rows and columns of the matrices in them; pairs verified at once.
FIRST, ROWS, COLUMNS, AT_ONCE = 24, 512, 2048, 16384


@lru_cache
def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def reach(least: float) -> float:
    """The squared distance allowed."""
    return max(2 - 2 * least, 0) * (1 + 1e-9) + 1e-12


def rotated(x: np.ndarray) -> np.ndarray:
    """The rotated unit vectors, as doubles."""
    x = x.astype(np.float64)
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # neither too large nor too small to be squared
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    return unit @ rotation(x.shape[1])


def marked(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key, v): key is equal for equal vectors, v the bytes of its numbers; both null where it links with nothing."""
    small_batches(vectors.sparkSession)
    number = number_of(vectors, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            keys, out = [None] * len(sizes), [None] * len(sizes)
            for dims in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dims)
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(number).reshape(len(at), dims) + number(0)
                fit = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                for i, v in zip(at[fit].tolist(), x[fit], strict=True):
                    out[i] = v.tobytes()
                    keys[i] = xxhash.xxh3_128_digest(out[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["id", "key", "v"])

    kind = "float" if number is np.float32 else "double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>"))
    return rows.mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, key binary, v binary")


def number_of(vectors: DataFrame, vector_col: str) -> type:
    """Floats move as floats, which halves what moves; all else as doubles."""
    return np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64


def matrix(column: pa.Array, number: type) -> np.ndarray:
    """The rotated unit vectors of a column of bytes of one length."""
    return rotated(np.frombuffer(b"".join(column.to_pylist()), number).reshape(len(column), -1))


def placed(points: DataFrame, number: type, least: float) -> DataFrame:
    """points, whose last column is v, with dims and the cell x, y."""
    small_batches(points.sparkSession)
    wide = max(math.sqrt(reach(least)), NARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(batch.num_columns - 1).to_pylist()], np.int64)
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                cell = np.floor(matrix(rows.column(rows.num_columns - 1), number)[:, :2] / wide).astype(np.int32)
                cell = np.pad(cell, ((0, 0), (0, 2 - cell.shape[1])))
                dims = np.full(len(cell), size // np.dtype(number).itemsize, np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, (dims, cell[:, 0], cell[:, 1]))], [*rows.schema.names, "dims", "x", "y"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{fields}, dims int, x int, y int")


class Links:
    """What the rows of two tiles tell of their links."""

    def __init__(self, u: np.ndarray, copies: np.ndarray, least: float) -> None:
        self.u, self.copies, self.least = u, copies, least
        own = u[:, :FIRST].astype(np.float32)
        half = (own * own).sum(axis=1, keepdims=True) / 2
        one = np.ones_like(half)
        # The product of a row of left and one of right is minus half the squared distance of their first components.
        self.left, self.right, self.limit = np.hstack([own, -half, one]), np.hstack([own, one, -half]), -reach(least) / 2 - 1e-5
        self.linked, self.head = np.zeros(len(u), np.int64), np.arange(len(u))

    def compare(self, a: np.ndarray, b: np.ndarray, rising: bool) -> None:
        """Rows a with rows b; only those of a before those of b if rising."""
        for i in range(0, len(a), ROWS):
            for j in range(0, len(b), COLUMNS):
                p, q = a[i : i + ROWS], b[j : j + COLUMNS]
                if rising and p[0] >= q[-1]:
                    continue
                near = np.flatnonzero(self.left[p] @ self.right[q].T >= self.limit)
                for k in range(0, len(near), AT_ONCE):
                    x, y = np.divmod(near[k : k + AT_ONCE], len(q))
                    x, y = p[x], q[y]
                    self.verify(*((x[x < y], y[x < y]) if rising else (x, y)))

    def verify(self, a: np.ndarray, b: np.ndarray) -> None:
        near = (self.u[a] * self.u[b]).sum(axis=1) >= self.least
        a, b = a[near], b[near]
        np.add.at(self.linked, a, self.copies[b])
        np.add.at(self.linked, b, self.copies[a])
        while True:
            x, y = self.head[a], self.head[b]
            if (x == y).all():
                return
            np.minimum.at(self.head, np.maximum(x, y), np.minimum(x, y))
            while (self.head != (up := self.head[self.head])).any():
                self.head = up


def tiled(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points with tile, a struct (dims, x, y, no), and (tile, rows) of each tile. There are as many tiles as cells, besides one for each TILE rows."""
    cells, _ = written(points.groupBy("dims", "x", "y").count())
    most = min(TILE, max(SMALL_TILE, math.ceil((cells.agg(F.sum("count")).first()[0] or 0) / TILES)))
    rows = points.join(F.broadcast(cells.withColumn("of", F.ceil(F.col("count") / most)).drop("count")), ["dims", "x", "y"])
    rows = rows.withColumn("tile", F.struct("dims", "x", "y", F.pmod(F.xxhash64("row"), F.col("of")).alias("no"))).drop("dims", "x", "y", "of")
    return rows, written(rows.groupBy("tile").agg(F.count("*").alias("rows")))[0]


def passes(tiles: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(tile, i, j, pass): each tile with every group i, j of tiles in cells side by side that it is in, and how many passes there are; in a pass its rows move about twice, or MOVED rows do."""
    i, j = (tiles.select(F.col("tile").alias(x), F.col("rows").alias(f"rows_{x}")) for x in "ij")
    side = (F.abs(F.col("i.x") - F.col("j.x")) <= 1) & (F.abs(F.col("i.y") - F.col("j.y")) <= 1)
    groups, _ = written(i.join(j, (F.col("i.dims") == F.col("j.dims")) & side & (F.col("i") <= F.col("j"))))
    moved = groups.agg(F.sum(F.col("rows_i") + F.when(F.col("i") < F.col("j"), F.col("rows_j")).otherwise(0))).first()[0] or 0
    of = max(1, math.ceil(moved / max(2 * rows, MOVED)))
    dealt = groups.select("i", "j", F.pmod(F.xxhash64("i", "j"), F.lit(of)).alias("pass"))
    return written(dealt.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"), "i", "j", "pass"))[0], of


def linked(rows: DataFrame, groups: DataFrame, number: type, least: float) -> DataFrame:
    """(row, links, head): for rows (row, copies, v, tile) linked in some of the groups, with how many vectors there, and the head of those."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        row, first = group.column("row").to_numpy(), group.column("first").to_numpy(zero_copy_only=False)
        found = Links(matrix(group.column("v"), number), group.column("copies").to_numpy(), least)
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        found.compare(a, b if len(b) else a, not len(b))
        at = np.flatnonzero(found.linked)
        return pa.table({"row": row[at], "links": found.linked[at], "head": row[found.head[at]]})

    both = rows.join(F.broadcast(groups.select("tile", "i", "j")), "tile").withColumn("first", F.col("tile") == F.col("i"))
    return both.select("i", "j", "row", "copies", "v", "first").groupBy("i", "j").applyInArrow(run, "row long, links long, head long")


def summed(found: list[DataFrame]) -> DataFrame:
    """(row, links, head) of what passes tell: the links of each row summed up, and as its head that of all that it is joined with."""
    told = reduce(DataFrame.unionByName, found)
    heads = components(told.where("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b")).distinct())
    counts = told.groupBy("row").agg(F.sum("links").alias("links"))
    return counts.join(heads.select(F.col("node").alias("row"), F.col("component").alias("head")), "row")


def all_linked(points: DataFrame, n: int, number: type, least: float) -> DataFrame:
    """(row, links, head), one of each linked row of the n points: with how many vectors, and the head of all that it is joined with."""
    rows, tiles = tiled(points.select("row", "copies", "v", "dims", "x", "y"))
    groups, of = passes(tiles, n)
    made, told = [], 0
    for k in range(of):
        made.append(written(linked(rows, groups.where(F.col("pass") == k), number, least)))
        told += made[-1][0].count()
        if told > 2 * n:
            made = [written(summed([x for x, _ in made]), *(path for _, path in made))]
            told = made[0][0].count()
    return written(summed([x for x, _ in made]), *(path for _, path in made))[0]


def near_vectors(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept): how many other vectors have a cosine of ``least`` or more with it, the smallest id that such links reach, and whether that is its own."""
    number = number_of(vectors, vector_col)
    marks = marked(vectors, id_col, vector_col)
    # Of equal vectors one stands for all: what is joined on a key that many rows share is written before.
    once = marks.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("own"), F.first("v").alias("v"))
    points, points_path = written(placed(once, number, least).withColumn("row", F.monotonically_increasing_id()))
    found = all_linked(points, points.count(), number, least)
    points, _ = written(points.select("row", "key", "copies", "own"), points_path)
    joined, path = written(found.join(points.select("row", "own"), "row"))
    named, name_path = written(joined.groupBy("head").agg(F.min("own").alias("least_id")))
    about = points.join(joined.join(named, "head").select("row", "links", "least_id"), "row", "left")
    told, _ = written(about.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least_id", "own").alias("component_id")), path, name_path)
    # Rows without a vector are dealt by their number, which is longer than a key.
    own = F.coalesce("key", F.concat(F.lit("no vector in row "), F.monotonically_increasing_id()).cast("binary"))
    rows = marks.select("id", own.alias("key")).join(told, "key", "left").withColumn("component_id", F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("id")))
    return rows.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Of all pairs: only for small tables.
ORACLE = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
      r AS (SELECT vec_id, vec_id AS to_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.to_id = l.a),
      c AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
      SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept FROM embeddings AS e LEFT JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
