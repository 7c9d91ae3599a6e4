"""Every operator against its SQL twin on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def cell(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float, np.number)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(repr([cell(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(ORACLES[name]).df())
