"""Exact quantiles of groups without a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact_quantile(df: DataFrame, key: str, value: str, p: float, name: str = "quantile", accuracy: int = 10_000) -> DataFrame:
    """``key`` and the ``p`` quantile of its values, interpolated between neighbours.

    A sketch brackets the quantile; its error is at most ``1 / accuracy`` of a group's
    rows. What lies below the bracket is counted, and only the distinct values inside are
    ranked, by their counts. Null values don't count; a group of them alone gives null; null keys
    are a group.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    margin = 2.0 / accuracy
    ends = [max(0.0, p - margin), min(1.0, p + margin)]
    groups = rows.groupBy("_k").agg(F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("_e"))
    # The ranks wanted, from 0, and the bracket; open where the sketch stands at an end.
    at = p * (F.col("_n") - 1)
    groups = groups.select("_k", F.floor(at).alias("_a"), F.ceil(at).alias("_b"), (at - F.floor(at)).alias("_part"), F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
    near = rows.where("_v IS NOT NULL").join(groups.withColumnRenamed("_k", "_g"), F.col("_k").eqNullSafe(F.col("_g"))).drop("_g")
    below = near.groupBy("_k").agg(F.count(F.when(F.col("_v") < F.col("_lo"), 1)).alias("_under"))
    # One row for each distinct value inside, so a value that most rows share is counted before the shuffle.
    values = near.where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy("_k", "_v", "_a", "_b", "_part").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("_k").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    inside = values.withColumn("_upto", upto).join(below.withColumnRenamed("_k", "_g"), F.col("_k").eqNullSafe(F.col("_g"))).drop("_g")
    end = F.col("_under") + F.col("_upto")
    pick = lambda c: F.max(F.when((F.col(c) >= end - F.col("_c")) & (F.col(c) < end), F.col("_v")))
    picked = inside.groupBy("_k").agg(pick("_a").alias("_x"), pick("_b").alias("_y"), F.first("_part").alias("_part"))
    found = picked.select(F.col("_k").alias("_g"), (F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_part")).alias(name))
    return groups.select("_k").join(found, F.col("_k").eqNullSafe(F.col("_g")), "left").select(F.col("_k").alias(key), name)
