"""What the operators on embeddings share: usable vectors, coarse centroids, inverted lists cut in blocks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an inverted list, and of the rows that visit it, that one task compares at a time.
BLOCK = 4096
#: Rows that centroids and codes are fitted on, and centroids, at most.
FIT_ROWS = 20_000
CELLS = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = lambda c: c.cast("double")
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (x(c) < float("inf")) & (x(c) > float("-inf"))), F.lit(False))


def padded(vector: Column, size: int, kind: str = "array<double>") -> Column:
    """Shorter vectors continued with zeros."""
    short = F.concat(vector.cast(kind), F.array_repeat(F.lit(0.0), F.lit(size) - F.size(vector)).cast(kind))
    return F.when(F.size(vector) < size, short).otherwise(vector.cast(kind))


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """A list column whose lists all have ``size`` numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), size)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)[: len(x) + 1], pa.array(x.ravel(), kind))


def sample(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Some ``FIT_ROWS`` of ``n`` rows, dealt by hash; fewer than twice that reach the task that cuts them."""
    if n > FIT_ROWS:
        rows = rows.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * FIT_ROWS / n)))
    return rows.limit(FIT_ROWS)


def centroids(rows: DataFrame, vector: str, n: int, cells: int | None = None) -> np.ndarray:
    """Centroids of k-means on a kept sample of a table of ``n`` rows, about its square root of them."""
    k = max(2, min(cells or CELLS, int(n**0.5)))  # Spark wants two; it finds fewer where there are fewer vectors
    fitted = KMeans(k=k, maxIter=8, seed=7, initSteps=2).fit(rows.select(array_to_vector(vector).alias("features")))
    return np.array(fitted.clusterCenters(), dtype=np.float64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``, never below zero."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def in_blocks(rows: DataFrame, visits: DataFrame, sizes: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """List rows and visits, both kept tables, with ``_block`` and ``_part``: for each cell a grid of blocks of its rows and of its visits.

    Rows are dealt to blocks by their place, not by value, so neither a cell with most
    of the rows nor one that everything visits ends in one task. ``sizes``: rows by cell.
    """
    spark = rows.sparkSession
    asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    cut = lambda n: max(1, -(-n // BLOCK))
    grid = F.broadcast(spark.createDataFrame([(c, cut(sizes[c]), cut(n)) for c, n in asked.items()], "cell int, _blocks int, _parts int"))
    at = lambda c: F.pmod(F.monotonically_increasing_id(), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.join(grid, "cell").withColumn("_block", at("_blocks")).withColumn("_part", each("_parts")).drop("_blocks", "_parts")
    right = visits.join(grid, "cell").withColumn("_part", at("_parts")).withColumn("_block", each("_blocks")).drop("_blocks", "_parts")
    return left, right


def batches(found: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterable[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, so that a table of distances to all centroids stays small."""
    for batch in found:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
