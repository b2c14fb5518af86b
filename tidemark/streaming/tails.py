"""Streams over logs and events. The same functions take batch frames, so they can be tested on either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import AUDIT


def tail(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """A log as a stream of its new entries."""
    return spark.readStream.schema(AUDIT).json(f"{root}/{kind}")


def deduped(df: DataFrame, key: str = "id", time: str = "at", late: str = "10 minutes") -> DataFrame:
    """Entries once each; state is dropped when the watermark has passed."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def _timed(df: DataFrame, time: str, late: str) -> DataFrame:
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if df.isStreaming else df


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and type."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = _timed(events, "ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: runs of events with pauses shorter than the gap."""
    grouped = _timed(events, "ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), "n")


def running_profile(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Incremental counts, nulls and extrema by key; run it in complete or update mode."""
    return events.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias("low"), F.max(value).alias("high"))
