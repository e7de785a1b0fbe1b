"""Joins that Spark has no operator for, as plain equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.ordered import carried, cut


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, take: list[str], parts: int | None = None) -> DataFrame:
    """Each left row with the columns ``take`` of the latest right row of its key that isn't later.

    Both sides are laid in one stream for each key and the last right row is
    carried forward, so no pair of rows is ever built and the only shuffle is
    the one on the key. Right rows at the same instant count as not later; of
    several at one instant the largest ``take`` values win. A left row without
    such a right row gets nulls. Null keys match nothing and stay out of the
    shuffle, so they don't meet in one task. Where one key can hold most of the rows, give
    ``parts``: rows are then dealt by key and time to so many segments, and each gets the last right
    row before it.
    """
    names = left.columns
    none = F.lit(None)
    taken = F.struct(*[right[c].alias(c) for c in take])
    lhs = left.where(F.col(by).isNotNull()).select(F.col(by).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"))
    rhs = right.where(F.col(by).isNotNull()).select(F.col(by).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), taken.alias("_seen"))
    both = lhs.withColumn("_seen", none.cast(rhs.schema["_seen"].dataType)).unionByName(rhs.withColumn("_row", none.cast(lhs.schema["_row"].dataType)))
    order = ["_t", "_side", "_seen"]
    if parts:
        out = carried(cut(both, "_k", order, parts), "_k", order, "_seen", "_seen").where("_side = 1")
    else:
        w = W.partitionBy("_k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        out = both.withColumn("_seen", F.last("_seen", ignorenulls=True).over(w)).where("_side = 1")
    found = out.select(*[F.col(f"_row.{c}").alias(c) for c in names], *[F.col(f"_seen.{c}").alias(f"asof_{c}") for c in take])
    alone = left.where(F.col(by).isNull()).select(*names, *[none.cast(right.schema[c].dataType).alias(f"asof_{c}") for c in take])
    return found.unionByName(alone)


def band_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with ``low <= value <= high``, by an equi-join on cells of ``width``.

    A right row is laid in each cell that its band touches; choose a width near
    the usual band so that this stays a small factor. Null bounds match nothing.
    """
    cell: Column = F.floor(F.col(value) / width).cast("long")
    cells = F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long")))
    rhs = right.where(F.col(low) <= F.col(high)).withColumn("_cell", cells)
    return left.withColumn("_cell", cell).join(rhs, "_cell").where(F.col(value).between(F.col(low), F.col(high))).drop("_cell")
