"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

A row's hash chooses one of SLOTS virtual slots for good. Bytes and rows are summed per slot. The first version of the map
deals slots out evenly before any data are known. Rebalancing edits the newest version: slots leave shards that are too heavy
by the bytes summed and go to the lightest, the rest stay in place, and the edit is stored as the next version. Rows are
placed by the newest version as read back from the store. The map has SLOTS rows whatever the data are.

Nulls and odd input: a null text has no bytes (size 1); the hash takes the id and the text's checksum, so rows with a null or
repeated id are still dealt out; rows equal in both are numbered, and all but the first hash their number too, so they are
spread like any others, as are equal texts under unlike ids; an empty table gives an empty result and a map of idle slots;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import new_folder, utf8_crc32, written

SLOTS, SHARDS = 8192, 16
#: Equal rows that one task writes out from their count.
COPIES = 1 << 16
MAP = "version int, virtual_slot int, shard int, n_rows long, n_bytes long"


def virtual_slot(*keys: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Virtual slot -> (rows, bytes); as many entries as slots at most. rows has virtual_slot and size."""
    sums = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    return {r.virtual_slot: (r.n, r.b) for r in sums.collect()}


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> dict[int, int]:
    """Slots dealt out in turn."""
    return {s: s % shards for s in range(slots)}


def rebalanced(old: Mapping[int, int], sizes: Mapping[int, tuple[int, int]], shards: int, slack: float = 0.02) -> dict[int, int]:
    """The next version of a map: slots of shards that are gone or over (1 + slack) of the mean move to the lightest shards, large slots first, so few move.

    Then the heaviest and the lightest shard trade one slot, or one for another, that brings them nearest, as long as they are over slack of the mean apart.
    """
    weight = lambda s: sizes.get(s, (0, 0))[1]
    mean = sum(map(weight, old)) / shards
    new = {s: k for s, k in old.items() if k < shards}
    loads = dict.fromkeys(range(shards), 0)
    for s, k in new.items():
        loads[k] += weight(s)
    moving = [s for s in old if s not in new]
    for s in sorted(new, key=lambda s: (-weight(s), s)):
        if loads[new[s]] > mean * (1 + slack) and weight(s) and loads[new[s]] - weight(s) >= mean * (1 - slack):
            loads[new[s]] -= weight(s)
            moving.append(s)
    heap = [(b, k) for k, b in loads.items()]
    heapq.heapify(heap)
    for s in sorted(moving, key=lambda s: (-weight(s), s)):
        b, k = heap[0]
        new[s] = k
        loads[k] += weight(s)
        heapq.heapreplace(heap, (b + weight(s), k))
    for _ in range(64 * shards):
        high, low = max(loads, key=loads.get), min(loads, key=loads.get)
        gap = loads[high] - loads[low]
        if gap <= slack * mean:
            break
        taken = sorted([(weight(s), s) for s, k in new.items() if k == low] + [(0, -1)])
        best = (gap, -1, -1, 0)
        for s in (s for s, k in new.items() if k == high):
            at = bisect.bisect(taken, (weight(s) - gap / 2, -1))
            for w, t in taken[max(0, at - 1) : at + 1]:
                best = min(best, (abs(gap - 2 * (weight(s) - w)), s, t, weight(s) - w))
        left, s, t, moved = best
        if left >= gap:
            break
        new[s] = low
        if t >= 0:
            new[t] = high
        loads[high] -= moved
        loads[low] += moved
    return new


def map_table(spark: SparkSession, placed: Mapping[int, int], sizes: Mapping[int, tuple[int, int]], version: int = 1) -> DataFrame:
    """The map as a table, to be appended to those of earlier versions (``write_map``)."""
    return spark.createDataFrame([(version, s, k, *sizes.get(s, (0, 0))) for s, k in sorted(placed.items())], MAP)


def write_map(new: DataFrame, path: str) -> None:
    """Stores a version (one per frame); to store it again changes nothing."""
    version = new.select("version").first()[0]
    new.drop("version").write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given or the newest version of a stored map."""
    kept = spark.read.parquet(path)
    at = kept.agg(F.max("version")).first()[0] if version is None else version
    return kept.where(F.col("version") == at).select(*[c.split()[0] for c in MAP.split(", ")])


def edited(spark: SparkSession, path: str, sizes: Mapping[int, tuple[int, int]], shards: int, slots: int, slack: float) -> DataFrame:
    """The newest map of the store after an edit for these sizes, stored as the version after it."""
    old = read_map(spark, path).select("version", "virtual_slot", "shard").collect()
    if len(old) != slots:
        raise ValueError(f"the stored map has {len(old)} slots, not {slots}")
    new = rebalanced({r.virtual_slot: r.shard for r in old}, sizes, shards, slack)
    write_map(map_table(spark, new, sizes, old[0].version + 1), path)
    return read_map(spark, path)


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, virtual_slot) of each row, written once; copy numbers rows that are equal in the first three.

    Equal rows meet as a count, made before the shuffle, and are written out from it in parts of COPIES, each in a place of its own.
    """
    text, key = F.col("text"), ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), utf8_crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    parts = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition("doc_id", "text_crc32", "first")
    each = parts.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + COPIES) - 1)))
    once, again = virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots=slots), virtual_slot(F.col("doc_id"), F.col("text_crc32"), F.col("copy"), slots=slots)
    return written(each.select(*key, "copy", F.when(F.col("copy") == 0, once).otherwise(again).alias("virtual_slot")))[0]


def placed_rows(rows: DataFrame, mapping: DataFrame, *order: str) -> DataFrame:
    """rows (with virtual_slot) with their shard, and slot: the row's place in its shard, gapless from 0.

    Places follow the virtual slots and in each the order columns; only slots are ranked, which hold a SLOTS-th of the rows.
    """
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = mapping.select("virtual_slot", "shard", "version", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    return rows.withColumn("rank", rank).join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("rank")).drop("start", "rank")


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slack: float = 0.0005, store: str | None = None) -> DataFrame:
    """The digest of op6 over doc_id and text. Law ``bytes``; virtual_slot and map_version follow.

    store: a folder that holds the map's versions, a new one under ``spark.checkpoint.dir`` if not given; it may hold some already.
    """
    spark, rows = docs.sparkSession, slotted(docs, slots)
    sizes = slot_sizes(rows)
    if store is None:
        store = new_folder(spark)
        write_map(map_table(spark, first_map(shards, slots), {}), store)
    mapping = edited(spark, store, sizes, shards, slots, slack)
    out = placed_rows(rows, mapping, "doc_id", "text_crc32", "size", "copy")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
