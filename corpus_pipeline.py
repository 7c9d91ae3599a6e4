"""A corpus pipeline of four operators: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. The first three return the columns
of docs; the last returns each kept document's place in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, simhash, toxicity
from tidemark.llm._common import columns, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    whole = docs.select(F.col("text"), F.struct(*columns(docs)).alias("row"))
    return quality.ledger(whole).where(quality.verdict()).select("row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model trained on those of them that are labelled, but for the held-out third."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.col("text"), F.struct(*columns(docs)).alias("row"))
    return toxicity.scored(whole, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id."""
    return simhash.without_copies(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("packing", length_packing),
]

#: SQL can express neither the trained classifier nor the fingerprints; ``tests/llm/test_pipeline.py`` holds each stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted once the next one is written, but for that which the result reads."""
    docs, gone = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), *gone)
        gone = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
