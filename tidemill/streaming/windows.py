"""Event-time jobs that take a batch or a streaming DataFrame alike.

A stream needs a time with a zone for its watermark. A batch has no watermark, so it
may keep a time without one; its windows then don't depend on the session's zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, at: str = "ts") -> DataFrame:
    """Watermarks want a time with a zone; the session's zone is taken."""
    return df.withColumn(at, F.col(at).cast("timestamp"))


def _watermarked(df: DataFrame, at: str, late: str) -> DataFrame:
    return df.withWatermark(at, late) if df.isStreaming else df


def tumbling(df: DataFrame, at: str, length: str, late: str, *keys: str) -> DataFrame:
    """Count and sum of ``value`` for each window of ``length`` and key; rows later than ``late`` are dropped from streams."""
    return _watermarked(df, at, late).groupBy(F.window(at, length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(df: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    return _watermarked(df, at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
