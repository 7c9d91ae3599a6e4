"""Operators stated as SQL over named inputs, run by Spark on DataFrames and by DuckDB as their twin."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.functions.lineage import checkpointed

#: $NAME in a statement: the Spark and the DuckDB spelling.
SPELLINGS = {"P": ("percentile", "quantile_cont"), "US": ("unix_micros(cast(ts AS TIMESTAMP))", "epoch_us(ts)"), "K": ("cast(get_json_object(props, '$.k') AS INT)", "cast(json_extract_string(props, '$.k') AS INT)")}

#: $NAME(x): $EACH(n) gives 0 to n - 1 in rows, $SPAN(a, b) a to b, $UNIFORM(text) a number in (0, 1) that the text settles.
SHAPES = {"EACH": (r"explode(sequence(0, \1 - 1))", r"unnest(range(\1))"), "SPAN": (r"explode(sequence(\1))", r"unnest(generate_series(\1))"), "UNIFORM": (r"((cast(conv(substr(md5(\1), 1, 13), 16, 10) AS DOUBLE) + 0.5E0) / 4503599627370496.0E0)", r"((cast(cast('0x' || substr(md5(\1), 1, 13) AS BIGINT) AS DOUBLE) + 0.5E0) / 4503599627370496.0E0)")}


@dataclass(frozen=True)
class Operator:
    """DataFrames in, a DataFrame out. Inputs stand in the statement as {name}, parameters as :name."""

    name: str
    doc: str
    inputs: tuple[str, ...]
    sql: str
    params: Mapping[str, object] = field(default_factory=dict)
    work: Callable[..., DataFrame] | None = None  # in place of the statement in Spark, where SQL can't do it at scale

    def text(self, engine: int, **params: object) -> str:
        out = self.sql
        for k, v in (dict(self.params) | params).items():
            out = re.sub(rf":{k}\b", str(v), out)
        for k, v in SPELLINGS.items():
            out = re.sub(rf"\${k}\b", lambda _, v=v: v[engine], out)
        for k, v in SHAPES.items():
            out = re.sub(rf"\${k}\(([^()]*)\)", v[engine], out)
        return out

    def __call__(self, *frames: DataFrame, **params: object) -> DataFrame:
        if self.work:
            return self.work(*frames, **params)
        return frames[0].sparkSession.sql(self.text(0, **params), **dict(zip(self.inputs, frames, strict=True)))


def spread(name: str, doc: str, inputs: tuple[str, ...], rows: str, keys: tuple[str, ...] = (), sums: Mapping[str, str] = {}, picks: Mapping[str, tuple[str, float, int]] = {}, params: Mapping[str, object] = {}) -> Operator:
    """An operator that groups rows, a statement, by keys: sums are aggregates by name, picks quantiles: (value, share, digits) by name.

    Its statement takes quantiles by ``percentile``; in Spark they come from running counts by ranges, as few keys may hold all rows.
    """
    shown = [*keys, *(f"{v} AS {n}" for n, v in sums.items()), *(f"round($P({v}, {p}), {d}) AS {n}" for n, (v, p, d) in picks.items())]
    whole = f"SELECT {', '.join(shown)} FROM ({rows}) AS rows_" + (f" GROUP BY {', '.join(keys)}" if keys else "")

    def work(*frames: DataFrame, **given: object) -> DataFrame:
        taken = Operator(name, doc, inputs, rows, params)(*frames, **given)
        values = {v: i for i, v in enumerate(dict.fromkeys(v for v, _, _ in picks.values()))}
        long = taken.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_what"), F.expr(v).cast("double").alias("x")) for v, i in values.items()])).alias("_v")).select(*keys, "_v._what", "_v.x")
        found = checkpointed(ranks.quantiles(long, [*keys, "_what"], {n: p for n, (_, p, _) in picks.items()}))
        out = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.expr(v).alias(n) for n, v in sums.items()]).drop("_rows")
        for v, i in values.items():
            own = [(n, d) for n, (w, _, d) in picks.items() if w == v]
            part = found.where(F.col("_what") == i)
            if keys:
                out = out.join(part.select(*keys, *[ranks.rounded(F.col(n), d).alias(n) for n, d in own]), list(keys), "left")
            else:  # one row on either side
                out = out.crossJoin(part.agg(*[ranks.rounded(F.max(n), d).alias(n) for n, d in own]))
        return out

    return Operator(name, doc, inputs, whole, params, work)


@dataclass
class Catalog:
    """Operators by name; an input is an operator's name or a given table."""

    operators: dict[str, Operator] = field(default_factory=dict)

    def add(self, *operators: Operator) -> None:
        for o in operators:
            if o.name in self.operators:
                raise ValueError(f"{o.name} is registered already")
            self.operators[o.name] = o

    def frame(self, spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
        """The operator's rows; an input that several operators share is made once (made: those so far)."""
        made = {} if made is None else made
        if name not in made:
            op = self.operators.get(name)
            made[name] = op(*(self.frame(spark, sf_dir, i, made) for i in op.inputs)) if op else spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return made[name]

    def oracle(self, name: str) -> str:
        steps: dict[str, str] = {}

        def visit(n: str) -> None:
            if n in self.operators and n not in steps:
                for i in self.operators[n].inputs:
                    visit(i)
                steps[n] = re.sub(r"\{(\w+)\}", r"\1", self.operators[n].text(1))

        visit(name)
        last = steps.pop(name)
        return (f"WITH {', '.join(f'{k} AS MATERIALIZED ({v})' for k, v in steps.items())} " if steps else "") + f"SELECT * FROM ({last}) AS result_"
