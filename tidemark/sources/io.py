"""Readers, exports and samples."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASCADE_COLUMNS = ("subject_uri", "repost_uri", "via_uri", "actor_did", "time_us", "is_repost")


def cascade_lines(spark: SparkSession, path: str) -> DataFrame:
    r"""Lines of a cascade dump with their fields and why they can't be read (reason): empty, under six fields, a time that is no whole number, or one beyond a long."""
    fields = F.split("line", "\t", -1)
    lines = spark.read.text(path).select(F.col("value").alias("line"), fields.alias("fields"), F.size(fields).alias("n"))
    time = F.get("fields", F.lit(4))
    whole = time.rlike("^[+-]?[0-9]+$")
    reason = F.when(F.length("line") == 0, "empty").when(F.col("n") < 6, "short").when(~whole, "time").when(time.try_cast("long").isNull(), "time range")
    return lines.withColumn("reason", reason)


def read_cascade_tsv(spark: SparkSession, path: str) -> DataFrame:
    r"""Tab-separated cascade dump: \N and NULL are null; what ``rejected_lines`` counts is dropped; fields after the sixth are ignored."""
    null = lambda c: F.when(~c.isin("\\N", "NULL"), c)
    field = {c: F.col("fields")[i] for i, c in enumerate(CASCADE_COLUMNS)}
    texts = [(null(c) if n in ("repost_uri", "via_uri") else c).alias(n) for n, c in field.items() if n not in ("time_us", "is_repost")]
    rows = cascade_lines(spark, path).where("reason IS NULL")
    return rows.select(*texts, field["time_us"].try_cast("long").alias("time_us"), field["is_repost"].isin("1", "true").alias("is_repost"))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """(reason, lines, example) of the lines of a cascade dump that are dropped."""
    return cascade_lines(spark, path).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("lines"), F.min("line").alias("example"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in dated folders to record columns."""
    raw = spark.read.schema("did string, time_us long, operation string, collection string, rkey string, record string").option("recursiveFileLookup", "true").json(path)
    get = lambda p: F.get_json_object("record", p)
    return raw.select("did", "time_us", "operation", "collection", "rkey", get("$.subject.uri").alias("subject_uri"), get("$.via.uri").alias("via_uri"), get("$['$type']").alias("type"))


#: The columns that reports read, in order; the tag of that layout is source_table.
EXPORT_COLUMNS = ("did", "session_start", "session_end", "next_session_start", "duration_s", "reposts", "posts_authored")


def export_sessions(sessions: DataFrame, path: str, source: str, columns: Sequence[str] = (), tag: str = "source") -> None:
    """CSV part files sorted by user and start: those columns in that order (all, if none are named), then the source; a null is empty. A column that isn't there is an error."""
    rows = sessions.select(*(columns or sessions.columns), F.lit(source).alias(tag))
    rows.repartitionByRange("did", "session_start").sortWithinPartitions("did", "session_start").write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def sample_users(df: DataFrame, n: int, seed: int = 0, user: str = "did") -> DataFrame:
    """All rows of n users, the same ones for the same seed."""
    users = df.select(user).distinct().orderBy(F.xxhash64(user, F.lit(seed)), user).limit(n)
    return df.join(users, user, "left_semi")


def sample_rows(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    return df.sample(fraction=percent / 100, seed=seed)
