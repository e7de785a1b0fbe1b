"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_live: set[str] = set()
#: Folders of local sessions that name none, by the id of the application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session that names none gets one temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="tidemill-")
    return _local[context.applicationId]


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def keep(df: DataFrame, name: str = "table", sweep: bool = True) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage: a lost executor costs at most the tasks that ran on
    it, and what is used twice is computed once. The table goes by ``forget`` or
    ``release``, at the latest when the driver's JVM ends. The shuffle files
    behind it go as soon as the driver has collected the finished plan; ``sweep``
    asks for that at once, which small tables needn't.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _live.add(path)
    return out


def forget(*kept: DataFrame) -> None:
    """Deletes the files of tables from ``keep`` that no later result reads."""
    for df in kept:
        release(df.sparkSession, {_paths[df]} & _live)


def tables() -> set[str]:
    """The folders of all tables kept so far."""
    return set(_live)


def release(spark: SparkSession, paths: Iterable[str], but: DataFrame | None = None) -> None:
    """Deletes tables once the results built on them are written; those that ``but`` reads stay."""
    read = {f.split("/")[-2] for f in but.inputFiles()} if but is not None else set()
    for path in paths:
        if path.rsplit("/", 1)[-1] not in read and path in _live:
            fs, p = _at(spark, path)
            fs.delete(p, True)
            _live.discard(path)
