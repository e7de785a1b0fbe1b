"""What the text operators share: scratch tables in the shared folder, and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources import scratch
from tidemill.sources.scratch import forget as forget
from tidemill.sources.scratch import release as release
from tidemill.sources.scratch import shared_folder as shared_folder
from tidemill.sources.scratch import tables as tables

#: ASCII white space between words, as regular-expression class content (Java, Python and RE2 alike).
SPACE = r"\x20\x09-\x0D"

#: Sizes of the batches that Python tasks get, in place of Spark's defaults: a batch of ten thousand texts holds memory that
#: executors don't give back. A session's own numbers stand.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Sets ``ARROW`` where the session has Spark's defaults; ``keep`` does so by itself."""
    for key, (usual, ours) in ARROW.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, ours)


def keep(df: DataFrame, name: str = "table", sweep: bool = True) -> DataFrame:
    """``scratch.keep`` with small Arrow batches."""
    small_batches(df.sparkSession)
    return scratch.keep(df, name, sweep)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it, that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, gone: DataFrame, key: dict[str, Column], most: int = 500_000) -> DataFrame:
    """``docs`` without the rows whose ``key``, expressions by name that are never null, is in the kept table ``gone``.

    Up to ``most`` rows, which are counted, ``gone`` is broadcast, so that texts stay
    where they are; a larger one is joined by a shuffle.
    """
    names = {c: fresh(docs, c) for c in key}
    gone = gone.select(*[F.col(c).alias(names[c]) for c in key])
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return docs.withColumns({names[c]: e for c, e in key.items()}).join(gone, list(names.values()), "left_anti").select(*docs.columns)


def remainder(id_col: str, n: int):
    """crc32 of an id written as text, modulo ``n``: a split of the rows that doesn't depend on their order."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]
