"""Cutting lineage in iterative operators, and dealing rows to tasks."""

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task takes of a table that several sorts and sums of one stage then hold.
ROWS_A_TASK = 250_000


def set_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; without one only a local master gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A name of a folder that isn't there yet, in the shared one."""
    return f"{set_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with the rows of a key together, in as many partitions as keep a task at ROWS_A_TASK on average, one a core at least.

    Adaptive execution sizes partitions by compressed bytes or by cores, so a task's rows would grow with the table.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS_A_TASK)), *keys)
