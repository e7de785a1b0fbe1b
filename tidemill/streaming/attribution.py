"""A join of two streams by key and interval of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str, prefix: str = "next_") -> DataFrame:
    """Each left row with the right rows of its key that come from its time to ``within`` after it, both ends included; nulls without any.

    Columns of ``right`` get ``prefix``. On streams both sides are buffered, a left row until the watermark
    has passed its time by ``within`` and a right row until the watermark has passed its own time, so state is bounded by the
    interval and ``late``. A left row without a partner comes out when its time is up. Rows later than
    ``late`` are dropped. A batch gives the same rows by an equi-join on the key. Null keys join nothing.
    """
    right = right.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    if left.isStreaming:
        left, right = left.withWatermark(at, late), right.withWatermark(f"{prefix}{at}", late)
    # A key that reads the time: a filter on the bare key would be pushed below the watermark and hold it back while only null keys come.
    right = right.withColumn(f"{prefix}{key}", F.when(F.col(f"{prefix}{at}").isNotNull(), F.col(f"{prefix}{key}")))
    gap = F.expr(f"interval {within}")
    on = (left[key] == right[f"{prefix}{key}"]) & (right[f"{prefix}{at}"] >= left[at]) & (right[f"{prefix}{at}"] <= left[at] + gap)
    return left.join(right, on, "left").drop(f"{prefix}{key}")
