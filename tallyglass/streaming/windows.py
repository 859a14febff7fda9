"""Event-time windows over a stream or a batch, beyond the review domain's own needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAMPS = ("timestamp", "timestamp_ntz")


def _stamped(events: DataFrame, ts: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, keys: list[str], size: str = "1 hour", late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums per key and window; late rows beyond the watermark are left out of a stream."""
    df = _stamped(events, ts)
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    out = df.groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, keys: list[str], size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    df = _stamped(events, ts)
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    out = df.groupBy(F.window(ts, size, step), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Sessions per key: a new one after a pause longer than ``gap``."""
    df = _stamped(events, ts)
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    out = df.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
