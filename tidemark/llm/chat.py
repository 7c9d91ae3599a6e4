"""Cumulative-snapshot collapse of logged conversations, and their rendering, in DataFrame functions alone.

A log that stores the whole conversation after each turn holds every shorter snapshot of it. A rolling hash over the turns
gives each prefix of each conversation a key; a conversation whose whole key is a proper prefix key of another goes, and of
conversations equal in all turns the one with the least id stays. What is left is rendered with a chat template.

Turns are ordered by (turn, role, text). The key after k turns is the running XOR of two 64-bit hashes of (place, role, text),
so it depends on the order. Places and keys are summed up in blocks of BLOCK turn numbers first, then over the few blocks of
a conversation, so a conversation that holds a third of all rows is shared out, unless its turns share few numbers. Rendered
text comes in pieces of BLOCK turns at most, as no row could hold such a conversation.

Roles and texts leave after they are ordered and hashed: keys are stored once, without them, and only the texts of kept
conversations are read again.

Nulls and odd input: rows with a null conv_id are one conversation; a null role or text differs from an empty one and renders
as empty; null turns come first; repeated rows are turns of their own; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed

BLOCK = 1024


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _placed(turns: DataFrame) -> DataFrame:
    """(conv_id, block, local, role, text): each turn's place in its block, from 1."""
    rows = turns.select("conv_id", "turn", "role", "text", F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(-1.0)) / BLOCK).alias("block"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    return rows.withColumn("local", F.row_number().over(W.partitionBy("conv_id", "block").orderBy(*order)))


def _blocks(placed: DataFrame) -> DataFrame:
    """(c, b, start, n_turns) of each block: the turns before it, and those of the whole conversation."""
    sizes = placed.groupBy("conv_id", "block").agg(F.max("local").alias("size"))
    of = W.partitionBy("conv_id")
    before = of.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(of).alias("n_turns"))


def keyed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, k1, k2, n_turns): places from 1, and the key of the prefix that ends there."""
    told = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    slim = checkpointed(_placed(turns).select("conv_id", "block", "local", F.xxhash64(F.lit(1), *told).alias("t1"), F.xxhash64(F.lit(2), *told).alias("t2")))
    at = _blocks(slim)
    rows = slim.join(at, _same("conv_id", "c") & (F.col("block") == F.col("b"))).withColumn("place", F.col("start") + F.col("local"))
    rows = rows.withColumn("h1", F.xxhash64("place", "t1")).withColumn("h2", F.xxhash64("place", "t2"))
    run = W.partitionBy("conv_id", "block").orderBy("local").rowsBetween(W.unboundedPreceding, 0)
    rows = checkpointed(rows.select("conv_id", "block", "place", "n_turns", F.bit_xor("h1").over(run).alias("r1"), F.bit_xor("h2").over(run).alias("r2")))
    last = rows.groupBy("conv_id", "block").agg(F.max(F.struct("place", "r1", "r2")).alias("e"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    past = last.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.bit_xor(f"e.r{i}").over(before), F.lit(0)).alias(f"p{i}") for i in (1, 2)])
    keys = [F.col(f"r{i}").bitwiseXOR(F.col(f"p{i}")).alias(f"k{i}") for i in (1, 2)]
    return rows.join(past, _same("conv_id", "c") & (F.col("block") == F.col("b"))).select("conv_id", "place", *keys, "n_turns")


def maximal(keyed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no prefix of a longer one, the least id of equal ones."""
    whole = keyed.where("place = n_turns").groupBy("n_turns", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = keyed.where("place < n_turns").select(F.col("place").alias("n_turns"), "k1", "k2").distinct()
    return whole.join(inner, ["n_turns", "k1", "k2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, n_copies, chat): kept conversations in pieces of BLOCK turns at most, in order from 0."""
    few = kept.select(F.col("conv_id").alias("k"), "n_copies")
    placed = _placed(turns.join(few, _same("conv_id", "k"), "left_semi"))
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    place = F.col("start") + F.col("local")
    # Sizes come of the turns' numbers alone, so that no text is read or sorted for them.
    sized = _blocks(turns.select("conv_id", F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(-1.0)) / BLOCK).alias("block")).groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("local")))
    lines = placed.join(sized, _same("conv_id", "c") & (F.col("block") == F.col("b"))).select("conv_id", place.alias("place"), F.floor((place - 1) / BLOCK).alias("piece"), "n_turns", turn.alias("line"))
    grouped = lines.groupBy("conv_id", "piece").agg(F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("place", "line"))).alias("turns"))
    chats = grouped.select("conv_id", "piece", "n_turns", F.array_join(F.transform("turns", lambda x: x["line"]), "").alias("chat"))
    return chats.join(few, _same("conv_id", "k")).select("conv_id", "piece", "n_turns", "n_copies", "chat")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    return rendered(turns, checkpointed(maximal(keyed_turns(turns))))


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line,
         coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) AS mark,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations),
p AS (SELECT *, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id, max(n_turns) AS n_turns, count(*) AS n_copies FROM p WHERE place = n_turns GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n_turns))
SELECT k.conv_id, CAST(floor((t.place - 1) / 1024.0) AS BIGINT) AS piece, CAST(k.n_turns AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies,
       string_agg(t.line, '' ORDER BY t.place) AS chat
FROM kept k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY ALL
"""
