"""A stream sink that can take a batch twice: versions of a table, swapped by one small file.

A streaming query that fails between writing and committing gives its last batch again. ``upsert``
keeps a table of the newest row for each key as folders of Parquet, one version for each
batch, and a pointer file that names the current version and the batch it holds. A batch
that the pointer already holds, or an older one, changes nothing. A new one is
merged into a folder that nobody reads yet; then the pointer is replaced by a rename, which
either happens or doesn't. Readers follow the pointer, so they see whole batches. The version before stays for
readers that began on it; older ones are deleted.

Rows are cut in ``buckets`` by a hash of the key and only buckets that the batch touches
are written anew; a version lists the folder of each bucket, so work grows with what changes.
Within a batch the row with the greatest ``version`` column of a key wins, and it replaces the stored one
unless that is greater; of equal ones the new row stands. Null keys are a key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
_POINTER = "current.json"


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _pointer(spark: SparkSession, folder: str) -> dict:
    fs, p = _fs(spark, f"{folder}/{_POINTER}")
    if not fs.exists(p):
        return {"batch": -1, "buckets": {}, "before": []}
    text = spark.read.text(f"{folder}/{_POINTER}", wholetext=True).first()[0]
    return json.loads(text)


def _swap(spark: SparkSession, folder: str, pointer: dict) -> None:
    """The pointer written beside and renamed over the old one."""
    jvm = spark.sparkContext._jvm
    _, new = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs, _ = _fs(spark, folder)
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{folder}/{_POINTER}"), options)


def upsert(folder: str, key: str, version: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = _pointer(spark, folder)
        if batch_id <= at["batch"]:
            return
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = batch.withColumns({"_bucket": bucket, "_new": F.lit(1)}).persist()
        try:
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]
            old = [at["buckets"][str(b)] for b in touched if str(b) in at["buckets"]]
            both = new
            if old:
                both = new.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumns({"_bucket": bucket, "_new": F.lit(0)}))
            newest = F.max_by(F.struct(*batch.columns), F.struct(version, "_new")).alias("row")
            to = f"{folder}/batch-{batch_id:010d}-{uuid.uuid4().hex}"
            merged = both.groupBy("_bucket", F.col(key).alias("_key")).agg(newest).select("row.*", "_bucket")
            merged.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(to)
        finally:
            new.unpersist()
        now = at["buckets"] | {str(b): f"{to}/_bucket={b}" for b in touched}
        _swap(spark, folder, {"batch": batch_id, "buckets": now, "before": sorted(set(at["buckets"].values()) - set(now.values()))})
        fs, _ = _fs(spark, folder)
        for path in at["before"]:  # replaced two versions ago
            fs.delete(_fs(spark, path)[1], True)

    return write


def current(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table as the last whole batch left it."""
    paths = sorted(_pointer(spark, folder)["buckets"].values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
