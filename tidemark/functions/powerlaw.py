"""Power-law tails of many keys at once: all candidates for the least value from one sorted pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import running


def candidates_by_log(counts: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, xmin): k values evenly spaced by logarithm from the least of counts (keys, x) to the greatest, rounded to whole numbers, each once."""
    ends = counts.groupBy(*keys).agg(F.log(F.min("x")).alias("_lo"), F.log(F.max("x")).alias("_hi"))
    place = lambda i: F.round(F.exp(F.col("_lo") + i * (F.col("_hi") - F.col("_lo")) / (k - 1)))
    # Keys are few bytes and k candidates each, so they are dealt to all cores; each key's list is freed of repeats by itself.
    dealt = ends.repartition(counts.sparkSession.sparkContext.defaultParallelism, *keys) if keys else ends
    return dealt.select(*keys, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), place))).alias("xmin")).where("xmin > 0")


def candidates_to_median(counts: DataFrame, k: int) -> DataFrame:
    """(xmin): k of the values of counts (x, n) up to the median of all, evenly by place; all of them if they are k at most."""
    # Of a value that stands n times, two are enough for the median's place; it is taken from running counts.
    placed = running(counts, [F.col("x")], {"_c": F.col("n")})
    lo, hi = (f((F.col("_c_of") - 1) / 2) for f in (F.floor, F.ceil))
    holds = lambda place: F.max(F.when((F.col("_c") - F.col("n") <= place) & (place < F.col("_c")), F.col("x")))
    middle = placed.agg(((holds(lo) + holds(hi)) / 2).alias("_middle"))
    half = counts.crossJoin(F.broadcast(middle)).where("x <= _middle").select("x")
    ranked = running(half, [F.col("x")], {"_r": F.lit(1).cast("long")})
    place, of = F.col("_r") - 1, F.col("_r_of")
    spot = lambda i: F.floor(i * (of - 1.0) / (k - 1))
    first = F.ceil(place * (k - 1.0) / F.greatest(of - 1, F.lit(1)))
    chosen = (of <= k) | (spot(first) == place) | (spot(first - 1) == place) | (spot(first + 1) == place)
    return ranked.where(chosen).select(F.col("x").alias("xmin"))


def fits(counts: DataFrame, candidates: DataFrame, keys: Sequence[str] = (), shift: float = 0.0, least: int = 10, ties: bool = False) -> DataFrame:
    """(keys, xmin, t, s, alpha, ks) of each candidate whose tail has ``least`` values: alpha = 1 + t / s, s the sum of ln(x / (xmin - shift)).

    counts: (keys, x, n). Suffix sums of n and n ln x, by ranges, give every candidate's t and s; a value's place in a tail
    follows from its own suffix count. Each value then meets the candidates of its key as one short list, so there is no join
    by inequality. ks is the greatest distance of the shares up to each distinct value; with ties also of the first of equal values.
    """
    real = counts.select(*keys, F.col("x").cast("double").alias("x"), F.col("n").cast("double").alias("n"), F.lit(1).alias("_real"))
    both = real.unionByName(candidates.select(*keys, F.col("xmin").cast("double").alias("x"), F.lit(0.0).alias("n"), F.lit(0).alias("_real")))
    sums = running(both, [F.col("x").desc(), F.col("_real").desc()], {"_ge": F.col("n"), "_gl": F.col("n") * F.log("x")}, keys)
    tails = sums.where("_real = 0").select(*keys, F.col("x").alias("xmin"), F.col("_ge").alias("t"), (F.col("_gl") - F.col("_ge") * F.log(F.col("x") - shift)).alias("s")).where((F.col("t") >= least) & (F.col("s") > 1e-9))
    tails = tails.withColumn("alpha", 1 + F.col("t") / F.col("s"))
    # As many as there are candidates for a key.
    lists = tails.groupBy(*keys).agg(F.collect_list(F.struct("xmin", "t", "s", "alpha")).alias("_tails"))
    values = sums.where("_real = 1").select(*keys, "x", "n", "_ge")
    met = values.join(lists, list(keys)) if keys else values.crossJoin(F.broadcast(lists))
    rows = met.select(*keys, "x", "n", "_ge", F.inline("_tails")).where("xmin <= x")
    model = 1 - F.pow((F.col("x") + shift) / (F.col("xmin") - shift), 1 - F.col("alpha"))
    off = lambda c: F.abs(c / F.col("t") - model)
    upto: Column = F.col("t") - F.col("_ge") + F.col("n")
    d = F.greatest(off(upto), off(upto - F.col("n") + 1)) if ties else off(upto)
    return rows.groupBy(*keys, "xmin", "t", "s", "alpha").agg(F.max(d).alias("ks"))


def _best_of(x: np.ndarray, k: int) -> tuple[float, ...] | None:
    """(xmin, t, s, alpha, ks) of rising x, over nought: of k candidates the first with the least distance, as of ``candidates_by_log``, ``fits`` and ``best``."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    values, n = x[first], np.diff(np.append(first, len(x))).astype(float)
    ln, lo, hi = np.log(values), np.log(x[0]), np.log(x[-1])
    xmin = np.unique(np.floor(np.exp(lo + np.arange(k) * (hi - lo) / (k - 1)) + 0.5))
    at = np.searchsorted(values, xmin)
    xmin, at = (a[(xmin > 0) & (at < len(values))] for a in (xmin, at))
    up = np.cumsum(n[::-1])[::-1]
    t = up[at]
    s = np.cumsum((n * ln)[::-1])[::-1][at] - t * np.log(xmin)
    good = (t >= 2) & (s > 1e-9)
    if not good.any():
        return None
    xmin, t, s = xmin[good], t[good], s[good]
    alpha = 1 + t / s
    column = lambda a: a[:, None]
    d = np.abs((column(t) - up + n) / column(t) - (1 - (values / column(xmin)) ** (1 - column(alpha))))
    ks = np.where(values >= column(xmin), d, 0.0).max(axis=1)
    i = np.argmin(np.round(ks, 9))
    return xmin[i], t[i], s[i], alpha[i], ks[i]


def best_of_runs(x: np.ndarray, starts: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``in_runs``: the power law of each run with ``least`` values."""
    ends = np.append(starts[1:], len(x))
    found = {i: _best_of(x[a:b], k) for i, (a, b) in enumerate(zip(starts, ends, strict=True)) if b - a >= least}
    found = {i: f for i, f in found.items() if f}
    return np.array(list(found), int), np.array(list(found.values()), float).reshape(-1, 5).T.copy()


def best(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of each key's fits the one of least ks, then least xmin."""
    first = F.min(F.struct(F.round("ks", 9).alias("_k"), "xmin", "t", "s", "alpha", "ks")).alias("_b")
    return found.groupBy(*keys).agg(first).where("_b IS NOT NULL").select(*keys, "_b.*").drop("_k")


def value_counts(rows: DataFrame, x: Column, keys: Sequence[str] = (), least: int = 0) -> DataFrame:
    """(keys, x, n) of the values over nought, of the keys that have ``least`` of them."""
    counts = rows.select(*keys, x.cast("double").alias("x")).where("x > 0").groupBy(*keys, "x").agg(F.count("*").alias("n"))
    if not least:
        return counts
    enough = counts.groupBy(*keys).agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).select(*keys)
    return counts.join(enough, list(keys))


