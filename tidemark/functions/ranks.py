"""Running sums and ranks by ranges: each range of a sorted table in its own task, shifted by the sums of the ranges before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpointed


def running(df: DataFrame, order: list[Column], sums: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """df with, for each name of sums, the sum of its value over the rows of the same keys up to each one (name) and over all of them (name_of).

    The order must tell the rows of a key apart. No task holds more than a range, whatever share of the rows a key has: a key
    that more than one range holds is the first or last of these, so what ranges tell of them is two rows a range, and only
    that is broadcast.
    """
    value = {name: f"_v_{name}" for name in sums}
    placed = checkpointed(df.withColumns({value[n]: c for n, c in sums.items()}).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    each = placed.groupBy("_range", *keys).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in value.items()])
    key = F.struct(F.lit(0).alias("_none"), *keys)
    ends = placed.groupBy("_range").agg(F.array(F.min(key), F.max(key)).alias("_ends"))
    ends = ends.select(F.explode("_ends").alias("_end")).distinct()
    each = each.withColumn("_key", key).join(F.broadcast(ends), F.col("_key").eqNullSafe(F.col("_end")), "left_semi")
    of, before = Window.partitionBy("_key"), Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("_range", "_key", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums], *[F.sum(f"_s_{n}").over(of).alias(f"_all_{n}") for n in sums])
    here = Window.partitionBy("_range", *keys)
    local = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumns({f"_up_{n}": F.sum(v).over(local) for n, v in value.items()} | {f"_own_{n}": F.sum(v).over(here) for n, v in value.items()})
    rows = rows.withColumnRenamed("_range", "_at").withColumn("_mine", key)
    rows = rows.join(F.broadcast(starts), (F.col("_at") == F.col("_range")) & F.col("_mine").eqNullSafe(F.col("_key")), "left")
    out = {n: F.coalesce(f"_start_{n}", F.lit(0)) + F.col(f"_up_{n}") for n in sums} | {f"{n}_of": F.coalesce(f"_all_{n}", f"_own_{n}") for n in sums}
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def ecdf(values: DataFrame) -> DataFrame:
    rows = running(values.groupBy("x").agg(F.count("*").alias("n")), [F.col("x")], {"c": F.col("n")})
    share = lambda c: F.round(c.cast("double") / F.col("c_of"), 9)
    return rows.select("x", "n", share(F.col("c")).alias("ecdf"), F.round(1 - F.col("c") / F.col("c_of"), 9).alias("ccdf"), F.round(1 - (F.col("c") - F.col("n")) / F.col("c_of"), 9).alias("ccdf_inclusive"))


def dense_ids(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("actor_id").alias("node")).union(edges.select("subject_id")).distinct()
    return running(nodes, [F.col("node")], {"id": F.lit(1).cast("long")}).select("node", (F.col("id") - 1).alias("id"))


def spearman(sessions: DataFrame) -> DataFrame:
    """Mean ranks from value counts, then their correlation."""
    pairs = sessions.where("duration_s > 0 AND next_session_start > session_end").select(F.col("duration_s").alias("x"), (F.col("next_session_start") - F.col("session_end")).alias("y"))
    pairs = checkpointed(pairs)
    for c in ("x", "y"):
        counts = running(pairs.groupBy(c).agg(F.count("*").alias("n")), [F.col(c)], {"s": F.col("n")})
        pairs = pairs.join(counts.select(c, (F.col("s") - (F.col("n") - 1) / 2.0).alias(f"r{c}")), c)
    return pairs.agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits as DuckDB rounds doubles: x times a power of ten to the nearest whole number, halves away from nought.

    Spark's own ``round`` takes the shortest decimals of x, so it goes the other way at some halves.
    """
    return F.round(x * 10.0**digits) / 10.0**digits


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: what a * b loses is taken from the halves of its factors."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (ah, al), (bh, bl), product = halves(a), halves(b), a * b
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    total = product + c
    grown = total - product
    return F.when(F.abs(a) < 1e290, total + (((product - (total - grown)) + (c - grown)) + lost)).otherwise(total)


def quantiles(values: DataFrame, keys: Sequence[str], wanted: Mapping[str, float], x: str = "x") -> DataFrame:
    """keys and, for each name wanted, that quantile of x by linear interpolation, as ``quantile_cont`` gives it to the last digit; nulls don't count.

    Value counts are summed up by ranges, so no task holds all values of a key, as one that runs ``percentile`` must.
    """
    counts = values.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    rows = running(counts, [F.col("_x")], {"_c": F.col("_n")}, keys)
    at = {name: F.lit(float(p)) * (F.col("_c_of") - 1) for name, p in wanted.items()}
    holds = lambda place: F.max(F.when((F.col("_c") - F.col("_n") <= place) & (place < F.col("_c")), F.col("_x")))
    picks = [f(p).alias(f"_{side}_{n}") for n, p in at.items() for side, f in (("lo", lambda p: holds(F.floor(p))), ("hi", lambda p: holds(F.ceil(p))))]
    picked = rows.groupBy(*keys).agg(F.max("_c_of").alias("_c_of"), *picks)
    part = {n: p - F.floor(p) for n, p in at.items()}
    return picked.select(*keys, *[fused(F.col(f"_lo_{n}"), 1 - part[n], part[n] * F.col(f"_hi_{n}")).alias(n) for n in wanted])
