"""Packing into optimal length buckets.

The lengths of all rows are counted once. Dynamic programming over that histogram chooses the ``buckets`` upper bounds that
minimise padding when each row is padded to the bound of its bucket. Inside a bucket, rows form batches of
``budget // bound`` rows (one at least), so a batch holds ``budget`` padded tokens at most, unless a single row is longer.

The histogram keeps every length, so the bounds are optimal; it has a row for each distinct length, so no more than the longest
text has tokens, however many rows there are. ``digits`` rounds longer lengths up to that many binary digits, where even such a
table is too large for the driver: twelve add under 0.05 % of padding and bound it to about 100,000 rows.
Batch numbers need each row's rank in its bucket: rows are dealt by hash into slices of about SLICE rows, ranked in their slice,
and shifted by the sizes of the slices before, so no bucket is one task.

Nulls and odd input: a null text has length 0; rows of length 0 are packed like others, in a bucket whose bound is 1 at least;
rows are dealt by id and text, so null ids by their text; of rows with
one id and length any order is right; repeated rows stay rows; an empty table gives an empty result; extra columns are ignored
by ``packed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import WORD, checkpointed

SLICE = 4096
BUCKETS, BUDGET = 16, 32768


def cell(length: Column, digits: int | None = None) -> Column:
    """The length itself, or rounded up to that many binary digits."""
    if digits is None:
        return length
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(length)) - digits, F.lit(0))).cast("long")
    return F.floor((length + step - 1) / step).cast("long") * step


def best_bounds(cells: Sequence[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds with the least sum of count * (bound - length) over (length, count) in rising order.

    With prefix counts C, the best last cut before j minimises best[i] - bound[j] * C[i]: lines in bound[j], slopes falling in i.
    """
    bound = [max(1, x) for x, _ in cells]
    counts = [0]
    for _, c in cells:
        counts.append(counts[-1] + c)
    n, cost, cuts = len(cells), [0.0] + [float("inf")] * len(cells), []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        new, cut = [float("inf")] * (n + 1), [0] * (n + 1)
        at = 0
        for j in range(1, n + 1):
            if cost[j - 1] < float("inf"):
                m, b = -counts[j - 1], cost[j - 1]
                while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - m) >= (b - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((m, b, j - 1))
            if not hull:
                continue
            at, x = min(at, len(hull) - 1), bound[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j], cut[j] = hull[at][0] * x + hull[at][1] + x * counts[j], hull[at][2]
        cuts.append(cut)
        if new[n] >= cost[n]:
            cuts.pop()
            break
        cost = new
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(bound[j - 1])
        j = cut[j]
    return sorted(set(out))


def bucket_table(lengths: DataFrame, length_col: str = "n_tokens", buckets: int = BUCKETS, digits: int | None = None) -> list[tuple[int, int]]:
    """(bound, rows) of each bucket, from the histogram over all rows."""
    cells = lengths.groupBy(cell(F.col(length_col), digits).alias("x")).agg(F.count(F.lit(1)).alias("n")).collect()
    cells = sorted((r.x, r.n) for r in cells)
    bounds = best_bounds(cells, buckets)
    rows = [0] * len(bounds)
    k = 0
    for x, n in cells:
        while bounds[k] < x:
            k += 1
        rows[k] += n
    return list(zip(bounds, rows, strict=True))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, digits: int | None = None) -> DataFrame:
    """(id_col, n_tokens, bucket, bound, batch, slot, padding): slot is the row's place in its batch, from 0.

    length: tokens of a row; the words of its text if not given.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.regexp_count(text, F.lit(WORD)) if length is None else length
    rows = checkpointed(docs.select(F.col(id_col), length.cast("long").alias("n_tokens"), F.xxhash64(F.col(id_col), text).alias("dealt")))
    table = bucket_table(rows, "n_tokens", buckets, digits)
    if not table:
        return rows.select(id_col, "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("bucket", "bound", "batch", "slot", "padding")])
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(k)) for k, (b, _) in enumerate(table)])
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket).withColumn("bound", pick([b for b, _ in table]))
    rows = rows.withColumn("slice", F.pmod("dealt", pick([-(-n // SLICE) for _, n in table])))
    sizes = rows.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy("bucket").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("bucket", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("bucket", "slice").orderBy(F.col(id_col).asc_nulls_first(), "n_tokens")) - 1
    ranked = rows.withColumn("rank", rank).join(starts, ["bucket", "slice"]).withColumn("rank", F.col("rank") + F.col("start"))
    room = pick([max(1, budget // b) for b, _ in table])
    return ranked.select(
        id_col, "n_tokens", F.col("bucket").cast("long").alias("bucket"), "bound",
        F.floor(F.col("rank") / room).alias("batch"), F.pmod("rank", room).alias("slot"), (F.col("bound") - F.col("n_tokens")).alias("padding"),
    )
