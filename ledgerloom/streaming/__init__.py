"""Structured Streaming forms of the queue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(events: DataFrame, key: str, ts: str = "ts", seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Tumbling counts per key; on a stream a watermark closes windows and drops their state."""
    w = F.window(ts, f"{seconds} seconds")
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def allowed(events: DataFrame, key: str, limit: int, ts: str = "ts", tie: str = "event_id", seconds: int = 60) -> DataFrame:
    """Batch form of the rate limit: adds allowed, true for the first ``limit`` events of a key in each fixed window.

    The window spreads a key over as many tasks' groups as it has windows, so a hot key is no single group.
    """
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    order = Window.partitionBy(key, "bucket").orderBy(ts, tie)
    return events.withColumn("bucket", bucket).withColumn("allowed", F.row_number().over(order) <= limit)


def once(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once: exactly-once effect of a queue that delivers at least once."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.groupBy(key).agg(F.min(ts).alias(ts))


def stale(jobs: DataFrame, updated: str, now: str, seconds: int) -> DataFrame:
    """Jobs last touched longer ago than twice their time limit."""
    return jobs.where(F.col(updated) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {2 * seconds} SECONDS"))


def first_seen(events: DataFrame, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream the first time their keys are seen, with their time ``value``. State of a key lasts until the watermark
    passes it by ``late``, so it doesn't grow without end; in a batch each key's least value."""
    if events.isStreaming:
        return events.select(*keys, value).withWatermark(value, late).dropDuplicatesWithinWatermark(keys)
    return events.groupBy(*keys).agg(F.min(value).alias(value))
