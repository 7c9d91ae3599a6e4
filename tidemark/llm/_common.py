"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space that separates words, and the pattern of a word.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

#: Rows and bytes handed to Python at once; few, as single texts may be very long.
ARROW_ROWS, ARROW_BYTES = 1024, "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder of ``spark.checkpoint.dir``; without one only a local master gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def with_arrow(df: DataFrame, taken: str, work: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]], new: StructType, drop: bool = False) -> DataFrame:
    """df with the columns of new, which work, called once a task, makes of the column taken in each Arrow batch.

    Columns of df that bear a name of new, in whatever case, are replaced; taken itself goes if drop is set.
    """
    small_batches(df.sparkSession)
    fresh = {n.lower() for n in new.fieldNames()}
    kept = [(n, c) for n, c in zip(df.columns, columns(df), strict=True) if n == taken or n.lower() not in fresh]
    rows = df.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(kept)])
    at = next(i for i, (n, _) in enumerate(kept) if n == taken)
    out = [i for i, (n, _) in enumerate(kept) if i != at or not (drop or n.lower() in fresh)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), *do(batch.column(at))], [*(f"c{i}" for i in out), *new.fieldNames()])

    schema = StructType([*(rows.schema.fields[i] for i in out), *new.fields])
    return rows.mapInArrow(run, schema).toDF(*(kept[i][0] for i in out), *new.fieldNames())


def new_folder(spark: SparkSession) -> str:
    """A name of a folder that isn't there yet, under ``spark.checkpoint.dir``."""
    set_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def deleted(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Whether Spark deletes the shuffle files of a query once it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, *gone: str) -> tuple[DataFrame, str]:
    """df as written to a new folder under ``spark.checkpoint.dir`` and read again, and that folder; then its shuffle files and the folders of gone are deleted."""
    spark = df.sparkSession
    path, before = new_folder(spark), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    deleted(spark, *gone)
    return spark.read.schema(df.schema).parquet(path), path


def utf8_crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def spare_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of df's, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
