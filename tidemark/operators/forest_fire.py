"""Forest-fire samples of the follow graph."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpointed, new_folder
from tidemark.functions.ranks import running
from tidemark.plans.operator import Operator as O


def _mark(*keys: object) -> Column:
    """Text that looks random and is the same for the same keys."""
    return F.md5(F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]))


def _uniform(*keys: object) -> Column:
    """In (0, 1), the same for the same keys."""
    return (F.conv(F.substring(_mark(*keys), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def most_burnt(p: float) -> int:
    """What burn_count never exceeds, as no uniform number is nearer to 1 than 2^-53."""
    return math.ceil(53 * math.log(2) / -math.log(p)) + 1


def burn_count(u: Column, p: float) -> Column:
    """Geometric with mean p / (1 - p)."""
    return F.floor(F.log(1 - u) / F.log(F.lit(p)))


def burnt(edges: DataFrame, targets: Sequence[int] = (50, 200), forward: float = 0.5, backward: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, place, sample) in the order they burn, and burned edges (node, to, ahead, round); edges has actor_id and subject_id.

    sample is the least target whose sample holds the node, so samples nest. Each round burns, from every node that began to
    burn in the round before, some of its edges out (ahead) and in, chosen by hash of edge, round and seed, that lead to
    nodes not yet burnt; a node burns once. Where the fire dies, the unburnt node of least hash lights it anew. The burnt
    nodes are a table with a folder for each round, and the frontier is the last of these, so the driver holds counts only. Of
    a node's edges no more are ranked than ``most_burnt``. An empty graph gives none.
    """
    spark, most = edges.sparkSession, max(targets)
    out = edges.select(F.col("actor_id").alias("node"), F.col("subject_id").alias("to"), F.lit(True).alias("ahead"))
    both = checkpointed(out.unionByName(edges.select(F.col("subject_id").alias("node"), F.col("actor_id").alias("to"), F.lit(False).alias("ahead"))).where("node <> to").distinct())
    nodes = checkpointed(both.select("node").distinct())
    kind = nodes.schema["node"].dataType.simpleString()
    fire, lit_edges = new_folder(spark), new_folder(spark)
    ashes = lambda: spark.read.schema(f"node {kind}, mark string, round int").parquet(fire)
    of_round = lambda n: spark.read.schema(f"node {kind}, mark string").parquet(f"{fire}/round={n}")
    placed, turn, fresh = 0, 0, 0
    while placed < most:
        if not fresh:
            unburnt = nodes.join(ashes().select("node"), "node", "left_anti") if turn else nodes
            unburnt.withColumn("mark", _mark(seed, F.col("node"))).orderBy("mark", "node").limit(1).write.parquet(f"{fire}/round={turn}")
        else:
            near = both.join(of_round(turn - 1).select("node"), "node").join(ashes().select(F.col("node").alias("to")), "to", "left_anti")
            rank = F.row_number().over(Window.partitionBy("node", "ahead").orderBy(_mark(seed, turn, F.col("node"), F.col("to"), F.col("ahead")), "to"))
            u = _uniform(seed, turn, F.col("node"), F.col("ahead"))
            count = F.when(F.col("ahead"), burn_count(u, forward)).otherwise(burn_count(u, backward))
            found = near.withColumn("rank", rank).where(F.col("rank") <= most_burnt(max(forward, backward))).where(F.col("rank") <= count)
            found.select("node", "to", "ahead").write.parquet(f"{lit_edges}/round={turn}")
            told = spark.read.schema(f"node {kind}, to {kind}, ahead boolean").parquet(f"{lit_edges}/round={turn}")
            told.groupBy(F.col("to").alias("node")).agg(F.min(_mark(seed, turn, F.col("node"), F.col("to"))).alias("mark")).write.parquet(f"{fire}/round={turn}")
        lone = not fresh
        fresh = of_round(turn).count()
        if lone and not fresh:
            break
        placed += fresh
        turn += 1
    if not placed:
        return nodes.select("node", F.lit(0).cast("long").alias("place"), F.lit(0).alias("sample")).limit(0), both.select("*", F.lit(0).alias("round")).limit(0)
    order = running(ashes(), [F.col("round"), F.col("mark"), F.col("node")], {"place": F.lit(1).cast("long")}).withColumn("place", F.col("place") - 1)
    sample = F.lit(None).cast("int")
    for t in sorted(targets, reverse=True):
        sample = F.when(F.col("place") < t, t).otherwise(sample)
    rows = checkpointed(order.where(F.col("place") < most).select("node", "place", sample.alias("sample")).orderBy("place"))
    if turn == 1 or not any_round(spark, lit_edges):
        return rows, both.select("*", F.lit(0).alias("round")).limit(0)
    burned = spark.read.schema(f"node {kind}, to {kind}, ahead boolean, round int").parquet(lit_edges)
    return rows, burned.join(rows.select(F.col("node").alias("to")), "to", "left_semi").select("node", "to", "ahead", "round")


def any_round(spark: object, folder: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def forest_fire(edges: DataFrame, *args: object, **params: object) -> DataFrame:
    return burnt(edges, *args, **params)[0]


def burned_edges(edges: DataFrame, *args: object, **params: object) -> DataFrame:
    return burnt(edges, *args, **params)[1]


OPERATORS = (
    O("j3_forest_fire", "Nested forest-fire samples.", ("follows",), "", {}, forest_fire),
    O("j3_burned_edges", "The edges along which the fire spread, with the round.", ("follows",), "", {}, burned_edges),
)
