"""Quantiles' rounding and fits of many users, against the statements in DuckDB."""

import duckdb
import numpy as np
import pandas as pd

from tidemark.functions import lineage, runs, weibull
from tidemark.operators import fits, sessions, tails
from tidemark.plans.operator import spread


def test_quantiles_round_halves_as_the_statement_does(spark):
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"k": np.repeat(np.arange(60), 150), "v": np.round(rng.uniform(0.7, 1.4, 9000), 5)})
    o = spread("t", "", ("t",), "SELECT k, v FROM {t}", ("k",), {"n": "count(*)"}, {f"p{p}": ("v", p / 100, 6) for p in (1, 5, 25, 50, 75, 95, 99)})
    want = duckdb.sql(o.text(1).replace("{t}", "df")).df().sort_values("k", ignore_index=True)
    got = o(spark.createDataFrame(df)).toPandas().sort_values("k", ignore_index=True)
    pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False, rtol=1e-12)


def test_weibull_of_keys_in_one_task_and_over_all_tasks(spark):
    rng = np.random.default_rng(5)
    sizes = [3, 9, 10, 11, 400, 25_000]
    did = np.repeat([f"u{i}" for i in range(len(sizes))], sizes)
    d1_gaps = pd.DataFrame({"did": did, "gap": (rng.weibull(0.8, len(did)) * 3e7).astype(np.int64) + 1})
    d1_gaps = pd.concat([d1_gaps, pd.DataFrame({"did": ["flat"] * 20 + [None] * 20 + ["u4"] * 2, "gap": [5] * 20 + list(range(1, 21)) + [0, -3]})], ignore_index=True)
    o = {o.name: o for o in fits.OPERATORS}["g8_weibull_fits"]
    want = duckdb.sql(o.text(1).replace("{d1_gaps}", "d1_gaps")).df().sort_values("did", ignore_index=True)
    frame = spark.createDataFrame(d1_gaps.sample(frac=1, random_state=1))
    for got in (o(frame), weibull.fits(frame, 10, most_alone=300)):
        pd.testing.assert_frame_equal(got.toPandas().sort_values("did", ignore_index=True), want, check_dtype=False, rtol=1e-9)


def test_weibull_joins_no_steps(spark):
    frame = spark.range(1000).selectExpr("concat('u', id % 7) AS did", "id * id + 1 AS gap")
    assert weibull.fits(frame, 10)._jdf.queryExecution().executedPlan().toString().count("Join") == 1


def test_power_laws_of_users_in_one_task_and_by_ranges(spark):
    rng = np.random.default_rng(6)
    sizes = [4, 9, 10, 60, 300, 3000]
    did = np.repeat([f"u{i}" for i in range(len(sizes))], sizes)
    gaps = pd.DataFrame({"did": did, "gap": (rng.pareto(1.1, len(did)) * 4e6).astype(np.int64) + 1_000_000})
    gaps = pd.concat([gaps, pd.DataFrame({"did": ["flat"] * 20 + [None] * 20 + ["tied"] * 40 + ["tiny"] * 30, "gap": [5_000_000] * 20 + list(range(1, 21)) + [2_000_000, 3_000_000, 3_000_000, 90_000_000] * 10 + list(range(1, 31))})], ignore_index=True)
    o = {o.name: o for o in tails.OPERATORS}["g6_user_powerlaw"]
    want = duckdb.sql(o.text(1).replace("{d1_gaps}", "gaps")).df().sort_values("did", ignore_index=True)
    assert len(want) > 3
    frame = spark.createDataFrame(gaps.sample(frac=1, random_state=1))
    for most in (10_000, 50):
        got = o(frame, most_alone=most).toPandas()[list(want.columns)].sort_values("did", ignore_index=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


def test_a_task_of_session_steps_holds_no_more_rows_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 100)
    ev = spark.range(3000).selectExpr("concat('u', id % 300) AS did", "id * 1000 AS time_us", "'x' AS event_type")
    for o in (o for o in sessions.OPERATORS if o.name in ("d1_gaps", "d4_sessions_rich", "d4_sessions_engaged")):
        assert o(ev).rdd.getNumPartitions() == 30


def test_a_task_of_sorted_passes_holds_no_more_rows_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 100)
    rows = spark.range(3000).selectExpr("concat('u', id % 300) AS did", "id + 1 AS gap")
    found, rest = runs.in_runs(rows, lambda x, starts: (np.arange(len(starts)), [np.diff(np.append(starts, len(x)))]), "n long", 50)
    assert rest is None and found.rdd.getNumPartitions() == 30
    assert sorted((r.did, r.n) for r in found.collect()) == sorted((f"u{i}", 10) for i in range(300))
