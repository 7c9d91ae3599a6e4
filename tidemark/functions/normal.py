"""Normal distributions cut from below, by maximum likelihood from two moments.

With y over the cut, z the cut in standard units and d(z) = hazard(z) - z, E[y] = sigma d and E[y^2] = sigma^2 (1 - z d). So
E[y^2] / E[y]^2 rises with z alone, from 1 to 2, and is found by halving. At 2 and more the exponential is the limit, and there
is no greatest likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TERMS, HALVINGS, FIRST = 60, 44, 20.0
_LN_2PI = "1.8378770664093453E0"


def _excess(z: np.ndarray) -> np.ndarray:
    """hazard(z) - z: a continued fraction from 1 up, else by the series of the distribution."""
    far, low = z, np.maximum(z, -8.0)
    for k in range(TERMS, 1, -1):
        far = z + k / far
    near, top = np.ones_like(z), np.exp(-low * low / 2) / 2.5066282746310002
    for k in range(2 * TERMS + 1, 1, -2):
        near = 1 + low * low * near / k
    return np.where(z >= 1, 1 / far, top / (0.5 - top * low * near) - z)


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """z and d(z) of rows with q, all rows of a batch at once."""
    for batch in batches:
        q = batch.column("q").to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            z, h = np.zeros(len(q)), FIRST
            for _ in range(HALVINGS):
                d = _excess(z)
                z, h = z + np.where((1 - z * d) / (d * d) < q, h, -h), h / 2
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z), pa.array(_excess(z))], [*batch.schema.names, "z", "d"])


def truncated(moments: DataFrame) -> DataFrame:
    """(did, mu, sigma, ln_q) of moments (did, a, m1, q): normal over a, where m1 is the mean of y = value - a and q that of y^2 over m1^2; ln_q is the logarithm of what lies over a. No row without a greatest likelihood."""
    # A row takes some thousands of steps, so even few rows are dealt to all cores.
    dealt = moments.where("q < 2").select("did", "a", "m1", "q").repartition(moments.sparkSession.sparkContext.defaultParallelism, "did")
    found = dealt.mapInArrow(_halved, StructType([*dealt.schema.fields, StructField("z", DoubleType()), StructField("d", DoubleType())]))
    sigma = F.col("m1") / F.col("d")
    ln_q = F.when(F.col("z") < -8, 0.0).otherwise(F.expr(f"-z * z / 2 - {_LN_2PI} / 2 - ln(d + z)"))
    return found.select("did", F.round(F.col("a") - F.col("z") * sigma, 5).alias("mu"), F.round(sigma, 6).alias("sigma"), F.round(ln_q, 7).alias("ln_q"))


def truncated_sql(moments: str) -> str:
    """The same for DuckDB, by a recursion."""
    far = "z"
    for k in range(TERMS, 1, -1):
        far = f"z + {k}.0E0 / ({far})"
    near, low = "1.0E0", "greatest(z, -8.0E0)"
    for k in range(2 * TERMS + 1, 1, -2):
        near = f"1 + w * ({near}) / {k}"
    top = f"exp(-{low} * {low} / 2) / 2.5066282746310002E0"
    excess = f"CASE WHEN z >= 1 THEN 1 / ({far}) ELSE ({top}) / (0.5E0 - ({top}) * {low} * ({near})) - z END"
    of = lambda name: f"(SELECT *, {excess} AS d FROM (SELECT *, {low} * {low} AS w FROM {name}) AS w_)"
    return f"""WITH RECURSIVE m AS ({moments}), b AS (SELECT did, a, m1, q, 0.0E0 AS z, {FIRST}E0 AS h, 0 AS i FROM m WHERE q < 2
      UNION ALL SELECT did, a, m1, q, z + CASE WHEN (1 - z * d) / (d * d) < q THEN h ELSE -h END, h / 2, i + 1 FROM {of("b")} AS e WHERE i < {HALVINGS})
      SELECT did, round(a - z * m1 / d, 5) AS mu, round(m1 / d, 6) AS sigma, round(CASE WHEN z < -8 THEN 0.0E0 ELSE -z * z / 2 - {_LN_2PI} / 2 - ln(d + z) END, 7) AS ln_q FROM {of("b")} AS e WHERE i = {HALVINGS}"""
