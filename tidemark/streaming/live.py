"""Streaming counterparts of hourly counts, fixed-gap sessions and de-duplication."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events (did, ts, event_type) per hour and type; later than the watermark is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").count().select(F.col("window.start").alias("hour"), "event_type", "count")


def live_sessions(stream: DataFrame, gap_s: int = 265, late: str = "10 minutes") -> DataFrame:
    """Sessions cut where a gap is over gap_s; session_end is the last event."""
    grouped = stream.withWatermark("ts", late).groupBy("did", F.session_window("ts", f"{gap_s} seconds")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("did", F.col("session_window.start").alias("session_start"), (F.col("session_window.end") - F.expr(f"interval {gap_s} seconds")).alias("session_end"), "events")


def deduplicated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["did", "ts", "event_type"])
