"""Centroid clustering of vectors of 64 whole numbers by bit planes.

A component x becomes the integer floor(256 x). Bit p of a vector's 64 components is one word of 64 bits, its plane p, in
two's complement: plane p weighs 2^p, the last -2^p. So a dot product is the sum over pairs of planes of their weights'
product times the bits that a plane of the vector and one of the centroid have in common, and a squared distance is
|v|^2 - 2 v.c + |c|^2: all exact. Vectors are stored once as planes; each round is one pass over that table in which a task
keeps, for each cluster, a count and 64 sums, so what moves is bounded by the clusters, however many vectors one of them holds.

Left out: vectors of another length, with a null or non-finite component, or with one of 2^27 or more after scaling, of which
a squared distance may not fit in a long. Null ids hash last among first centroids, repeated rows stay rows, ties go to the
smaller number, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import small_batches, written

DIMS, SCALE, MOST = 64, 256, 2**27


def weights(n: int) -> np.ndarray:
    out = np.int64(1) << np.arange(n, dtype=np.int64)
    out[-1:] *= -1
    return out


def planes(v: np.ndarray) -> np.ndarray:
    """(n, 64) integers to (n, planes) words, as few planes as the largest needs."""
    n = int((v ^ (v >> 63)).max(initial=0)).bit_length() + 1
    bits = (v[:, None, :] >> np.arange(n, dtype=np.int64)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def numbers(words: np.ndarray) -> np.ndarray:
    """The integers of planes."""
    bits = np.unpackbits(np.ascontiguousarray(words)[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return np.einsum("npc,p->nc", bits.astype(np.int64), weights(words.shape[1]))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the vectors with planes a (n, p) and b (k, q)."""
    out = np.zeros((len(a), len(b)), np.int64)
    for p, x in enumerate(weights(a.shape[1])):
        for q, y in enumerate(weights(b.shape[1])):
            out += x * y * np.bitwise_count(a[:, p, None] & b[None, :, q]).astype(np.int64)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    w = weights(a.shape[1])
    return sum((x * y * np.bitwise_count(a[:, p] & a[:, q]).astype(np.int64) for p, x in enumerate(w) for q, y in enumerate(w)), np.zeros(len(a), np.int64))


def nearest(a: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector with planes a the number of the nearest centroid, the smallest on ties, and the squared distance."""
    c = planes(centroids)
    far = squares(a)[:, None] - 2 * dots(a, c) + squares(c)[None, :]
    at = far.argmin(axis=1)
    return at, far[np.arange(len(a)), at]


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which lists of a column of floats are kept, and their integers."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(sizes == DIMS)
    x = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMS)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * SCALE)
        good = (np.abs(x) < MOST).all(axis=1)  # a null is a NaN here
    return fit[good], x[good].astype(np.int64)


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, planes) of the vectors that are kept."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, v = whole(batch.column(1))
            words = planes(v)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(words.view(np.int64).ravel()), words.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), lists], ["id", "planes"])

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>"))
    return rows.mapInArrow(run, f"id {kind}, planes array<long>")


def words_of(column: pa.Array) -> np.ndarray:
    """(n, planes) words; shorter ones repeat the plane of the sign."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    if not len(sizes):
        return np.empty((0, 1), np.uint64)
    at = (np.cumsum(sizes) - sizes)[:, None] + np.minimum(np.arange(sizes.max()), sizes[:, None] - 1)
    out = flat[at]
    return out


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over rows (planes): floor of the mean of each one's vectors; those without any stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        for batch in batches:
            words = words_of(batch.column(0))
            at, _ = nearest(words, centroids)
            count += np.bincount(at, minlength=k)
            np.add.at(total, at, numbers(words))
        some = np.flatnonzero(count)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), DIMS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), lists], ["cluster", "n", "total"])

    sums = rows.select("planes").mapInArrow(run, "cluster int, n long, total array<long>").groupBy("cluster")
    out = centroids.copy()
    # A row for each cluster at most.
    for r in sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(DIMS)]).alias("total")).collect():
        out[r.cluster] = [x // r.n for x in r.total]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of rows (id, planes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = nearest(words_of(batch.column(1)), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(far)], ["id", "cluster", "distance"])

    return rows.select("id", "planes").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors that are kept.

    The first centroids are the k vectors whose ``seed:id`` has the smallest SHA-256, in that order.
    """
    spark = vectors.sparkSession
    rows, path = written(packed(vectors, id_col, vector_col))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "planes").limit(k).collect()
    centroids = np.array([numbers(np.array([r.planes], np.int64).view(np.uint64))[0] for r in first], np.int64).reshape(-1, DIMS)
    for _ in range(rounds if first else 0):
        centroids = moved(rows, centroids)
    if not first:
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    placed, _ = written(assigned(rows, centroids), path)
    # A row for each cluster at most.
    spent = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    about = [(c, d, sum(spent.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in spent.items()]
    told = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5) -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.c[i] - c.c[i]) * (v.c[i] - c.c[i])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, min(CAST({far} AS HUGEINT) * 64 + k) AS m FROM v CROSS JOIN c{i} AS c GROUP BY vec_id)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT m % 64 AS k, i, sum(v.c[i]) AS s, count(*) AS n FROM a{i} JOIN v USING (vec_id) CROSS JOIN range(1, 65) AS r(i) GROUP BY 1, 2)")
            steps.append(f"u{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY k)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(u.c, o.c) AS c FROM c{i} AS o LEFT JOIN u{i} AS u ON o.k = u.k)")
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, c FROM (SELECT sha256('2:' || vec_id) AS h, c FROM v ORDER BY h LIMIT {k}) AS f), {", ".join(steps)},
      r AS (SELECT vec_id, CAST(m % 64 AS INTEGER) AS cluster, CAST(m // 64 AS BIGINT) AS distance FROM a{rounds})
      SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM r JOIN c{rounds} AS c ON r.cluster = c.k"""


#: Ids are taken to be unlike, as in the given table.
ORACLE = _oracle()
