"""Readers and writers for the tables that the jobs work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table below ``base``; any path that Spark can read will do."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Write Parquet in one folder for each value of ``by``.

    Rows are rebalanced on the keys first, so that each task writes few files
    and adaptive execution splits a folder that holds most of the rows.
    """
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
