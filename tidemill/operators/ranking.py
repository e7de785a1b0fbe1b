"""Top rows of groups, and ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.sources.scratch import keep

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def top_k_by(df: DataFrame, key: str, order: list[Column], k: int, name: str = "rk") -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes each map task to ``k`` rows of a key before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number", parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of ``order`` over the whole table.

    A window without a partition key would sort everything in one task. Here
    rows are dealt by range and sorted in their partitions, a row's place in its
    partition is read off, and the counts of the ``parts`` partitions, all that goes to the
    driver, give the places where partitions begin. Ranges split between equal rows
    only where ``order`` tells them apart, so let it end in a unique column; rows that it
    doesn't tell apart are numbered in any order and stay in one partition. Nulls stand where ``order`` puts them. The dealt rows are a
    kept table, since a second sampling of the ranges could cut elsewhere.
    """
    spark = df.sparkSession
    at = _fresh(df, "_at")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = keep(sorted_rows.withColumn(at, F.monotonically_increasing_id()), "places")
    part = F.shiftright(F.col(at), _PLACE_BITS).alias("_p")
    counts = sorted((r["_p"], r["count"]) for r in placed.groupBy(part).count().collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    begin = spark.createDataFrame(list(starts.items()), "_p long, _begin long")
    place = F.col("_begin") + F.col(at).bitwiseAND((1 << _PLACE_BITS) - 1) + 1
    return placed.join(F.broadcast(begin), F.shiftright(F.col(at), _PLACE_BITS) == F.col("_p")).select(*df.columns, place.alias(name))


def ranks(df: DataFrame, by: str, unique: str, descending: bool = False, tiles: int = 4, parts: int | None = None) -> DataFrame:
    """``df`` with ``row_number``, ``rank``, ``dense_rank``, ``percent_rank``, ``cume_dist`` and ``ntile`` in the order of ``by`` over the whole table.

    Rows with equal ``by`` are told apart by ``unique`` in ``row_number`` and ``ntile`` alone. Ranks of equal
    rows come from one row for each distinct value, so a value that a third of
    the rows share is counted before the shuffle and never sorted in one task. Nulls come first, or last
    where ``descending``, and are equal to each other.
    """
    taken = [c for c in df.columns if c in _RANKS]
    if taken:
        raise ValueError(f"columns named like results: {taken}")
    side = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_first())
    numbered = keep(row_numbers(df, [side(by), F.col(unique)], parts=parts), "numbered")
    n = numbered.count()
    value = _fresh(df, "_value")
    values = numbered.groupBy(F.col(by).alias(value)).agg(F.min("row_number").alias("rank"), F.max("row_number").alias("_upto"))
    values = keep(row_numbers(values, [side(value)], "dense_rank", parts), "values")
    small, more = divmod(n, tiles)
    wide = more * (small + 1)
    at = F.col("row_number") - 1
    tile = F.when(at < wide, F.floor(at / (small + 1))).otherwise(more + F.floor((at - wide) / max(small, 1))) + 1
    return numbered.join(values, F.col(by).eqNullSafe(F.col(value))).select(
        *df.columns, "row_number", "rank", "dense_rank", (F.lit(0.0) if n < 2 else (F.col("rank") - 1) / (n - 1)).alias("percent_rank"),
        (F.col("_upto") / n).alias("cume_dist"), tile.cast("long").alias("ntile"),
    )


_RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name
