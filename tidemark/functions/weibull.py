"""Weibull fits of many keys by Newton's steps on the shape, of values over their key's mean."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.runs import in_runs

#: Values of one key that a task fits on its own at most; keys with more are fitted by sums over all tasks.
MOST_ALONE, STEPS = 50_000, 7


def _solved(x: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The runs of x with ``least`` values that aren't all alike; their n, shape and scale."""
    n = np.diff(np.append(starts, len(x)))
    mean_of = lambda v: np.add.reduceat(v, starts) / n
    mean = mean_of(x)
    ln = np.log(x / np.repeat(mean, n))
    ln_mean = mean_of(ln)
    sd = np.sqrt(mean_of((ln - np.repeat(ln_mean, n)) ** 2))
    k = np.where(sd > 1e-9, 1.2 / sd, np.nan)
    for _ in range(STEPS):
        e = np.exp(np.repeat(k, n) * ln)
        s0, s1, s2 = mean_of(e), mean_of(e * ln), mean_of(e * ln * ln)
        k = np.maximum(k - (s1 / s0 - 1 / k - ln_mean) / (s2 / s0 - (s1 / s0) ** 2 + 1 / (k * k)), k / 4)
    scale = mean * mean_of(np.exp(np.repeat(k, n) * ln)) ** (1 / k)
    kept = np.flatnonzero((n >= least) & ~np.isnan(k))
    return kept, [n[kept], k[kept], scale[kept]]


def _together(rows: DataFrame, least: int) -> DataFrame:
    """The same of rows (did, gap) of few keys: a step is one sum over all rows, and only the keys' numbers are broadcast."""
    x = F.col("gap") / 1e6
    means = rows.groupBy("did").agg(F.count("*").alias("n"), F.avg(x).alias("mean")).where(F.col("n") >= least)
    values = rows.join(F.broadcast(means), "did").select("did", "n", "mean", F.log(x / F.col("mean")).alias("ln"))
    state = values.groupBy("did", "n", "mean").agg(F.avg("ln").alias("ln_mean"), F.stddev_pop("ln").alias("sd")).where("sd > 1e-9").selectExpr("did", "n", "mean", "ln_mean", "1.2E0 / sd AS k")
    values = values.select("did", "ln")
    for _ in range(STEPS):
        sums = values.join(F.broadcast(state), "did").groupBy(*state.columns).agg(*[F.avg(F.expr(f"exp(k * ln){times}")).alias(f"s{i}") for i, times in enumerate(("", " * ln", " * ln * ln"))])
        state = sums.selectExpr("did", "n", "mean", "ln_mean", "greatest(k - (s1 / s0 - 1 / k - ln_mean) / (s2 / s0 - (s1 / s0) * (s1 / s0) + 1 / (k * k)), k / 4) AS k")
    last = values.join(F.broadcast(state), "did").groupBy(*state.columns).agg(F.avg(F.expr("exp(k * ln)")).alias("p"))
    return last.selectExpr("did", "n", "k AS shape", "mean * pow(p, 1 / k) AS scale")


def fits(gaps: DataFrame, least: int, most_alone: int = MOST_ALONE) -> DataFrame:
    """(did, n, shape, scale) of the values over nought of gaps (did, gap), in seconds, of the keys that have ``least`` of them. gaps is read three times."""
    rows = gaps.where("gap > 0 AND did IS NOT NULL").select("did", "gap")
    found, rest = in_runs(rows, lambda x, starts: _solved(x, starts, least), "n long, shape double, scale double", most_alone)
    if rest is not None:
        found = found.unionByName(_together(rest, least))
    return found.select("did", "n", F.round("shape", 5).alias("shape"), F.round("scale", 4).alias("scale"))
