"""Ranks over a whole table against one window in DuckDB, and no task with all rows."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators.ranking import ranks, row_numbers
from tidemill.sources import scratch

SQL = """SELECT id, v, row_number() OVER a AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank,
  cume_dist() OVER w AS cume_dist, ntile({tiles}) OVER a AS ntile FROM t WINDOW w AS (ORDER BY v {side}), a AS (ORDER BY v {side}, id)"""


@pytest.mark.parametrize(("n", "tiles", "descending"), [(0, 4, False), (1, 4, False), (3, 4, True), (1000, 7, False), (1001, 10, True)])
def test_ranks_against_sql(spark, n, tiles, descending):
    """Half the rows share one value; nulls and repeated values are among them."""
    rng = random.Random(n)
    rows = [(i, rng.choice([5, 5, 5, None, *range(40)])) for i in range(n)]
    t = pd.DataFrame(rows, columns=["id", "v"]).astype({"id": "int64", "v": "Int64"})  # noqa: F841
    want = duckdb.connect().execute("CREATE TABLE t AS SELECT * FROM t").execute(SQL.format(tiles=tiles, side="DESC NULLS LAST" if descending else "NULLS FIRST")).fetchall()
    got = ranks(spark.createDataFrame(rows, "id long, v long"), "v", "id", descending, tiles, parts=5)
    names = ["id", "v", "row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"]
    assert sorted(map(tuple, got.select(*names).collect())) == [pytest.approx(w) if w[1] is not None else w[:1] + (None,) + pytest.approx(w[2:]).expected for w in sorted(want)]


def test_no_partition_holds_all_rows(spark):
    """One value for every row, told apart by the id: the largest range stays near its share."""
    df = spark.range(0, 20_000, 1, 7).select("id", F.lit(1).alias("v"), F.lit("x").alias("_at"))
    got = row_numbers(df, [F.col("v"), F.col("id")], "n", parts=10)
    assert got.columns == ["id", "v", "_at", "n"] and got.where("n <> id + 1").count() == 0
    assert "Window" not in got._jdf.queryExecution().toString()
    kept = next(p for p in scratch.tables() if "places" in p and spark.read.parquet(p).count() == 20_000)
    sizes = [r["count"] for r in spark.read.parquet(kept).groupBy(F.expr("shiftright(__at, 33)")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 5_000


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="rank"):
        ranks(spark.range(3).withColumn("rank", F.lit(1)), "id", "id")


def test_local_sessions_without_a_shared_folder(spark, monkeypatch):
    """Without ``spark.checkpoint.dir``, a local session gets one folder; a cluster is told to set it."""
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: default[0] if key == "spark.checkpoint.dir" else get(self, key, *default))
    folder = scratch.shared_folder(spark)
    assert "tidemill-" in folder and scratch.shared_folder(spark) == folder
    assert scratch.keep(spark.range(5)).count() == 5
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,1024]")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(spark)
