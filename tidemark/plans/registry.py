"""Queries over the given tables by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import activity, cascades, density, engagement, events, fits, forest_fire, sessions, tails
from tidemark.plans.operator import Catalog
from tidemark.sources.adapters import ADAPTERS

CATALOG = Catalog()
CATALOG.add(*ADAPTERS)
_OPERATORS = [o for m in (events, activity, sessions, density, fits, tails, cascades, engagement, forest_fire) for o in m.OPERATORS]
CATALOG.add(*_OPERATORS)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return CATALOG.frame(spark, sf_dir, name)

    return run


QUERIES = {o.name: _query(o.name) for o in _OPERATORS}
#: An operator without a statement has no twin.
ORACLES = {o.name: CATALOG.oracle(o.name) for o in _OPERATORS if o.sql}
