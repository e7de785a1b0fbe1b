"""The sink under replayed batches, failures between write and swap, and updates; functions for SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.functions.tables import register
from tidemill.plans import registry
from tidemill.streaming import sink

SCHEMA = "k string, v int, seq long"


def state(spark, folder):
    return sorted(map(tuple, sink.current(spark, folder, SCHEMA).collect()), key=repr)


def test_replayed_batches_change_nothing(spark, tmp_path, monkeypatch):
    folder, rng, want = str(tmp_path / "t"), random.Random(3), {}
    write = sink.upsert(folder, "k", "seq", buckets=4)
    assert state(spark, folder) == []
    for b in range(5):
        rows = [(rng.choice(["a", "b", "c", "d", None, f"n{b}"]), rng.randrange(99), rng.randrange(5) + 3 * b) for _ in range(12)]
        rows = list({(k, s): (k, v, s) for k, v, s in rows}.values())
        df = spark.createDataFrame(rows, SCHEMA)
        if b == 3:  # the folder is written, the swap fails: readers see the batch before
            before = state(spark, folder)
            with monkeypatch.context() as m:
                m.setattr(sink, "_swap", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    write(df, b)
            assert state(spark, folder) == before
        write(df, b)
        for k, v, s in rows:
            if k not in want or s >= want[k][2]:
                want[k] = (k, v, s)
        now = sorted(want.values(), key=repr)
        assert state(spark, folder) == now
        write(df, b)
        write(spark.createDataFrame([("a", -1, 10**6)], SCHEMA), b - 1)  # an older batch once more
        assert state(spark, folder) == now


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "t")
    write = sink.upsert(folder, "k", "seq", buckets=8)
    write(spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("v"), F.lit(0).cast("long").alias("seq")), 0)
    one = sink._pointer(spark, folder)["buckets"]
    write(spark.createDataFrame([("k7", 2, 1)], SCHEMA), 1)
    two = sink._pointer(spark, folder)["buckets"]
    assert len(one) == 8 and sum(one[b] != two[b] for b in one) == 1
    assert sink.current(spark, folder, SCHEMA).count() == 200 and sink.current(spark, folder, SCHEMA).where("v = 2").count() == 1


def test_a_stream_into_the_sink_over_restarts(spark, tmp_path):
    schema = "k string, v int, seq long"
    write = sink.upsert(f"{tmp_path}/t", "k", "seq")
    for i in range(3):
        spark.range(40).select(F.concat(F.lit("k"), F.col("id") % 10).alias("k"), F.lit(i).alias("v"), (F.col("id") + 100 * i).alias("seq")).write.mode("append").parquet(f"{tmp_path}/in")
        q = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
        q.awaitTermination()
    assert state(spark, f"{tmp_path}/t") == [(f"k{i}", 2, 230 + i) for i in range(10)]


def zigzag(values, by):
    out, low, high, rising = [], None, None, None
    for at, x in values:
        if x is None:
            continue
        if low is None:
            low = high = (at, x)
        elif rising is None:
            low, high = min(low, (at, x), key=lambda p: p[1]), max(high, (at, x), key=lambda p: p[1])
            if x >= low[1] * (1 + by):
                rising, high = True, (at, x)
                out.append((*low, "low"))
            elif x <= high[1] * (1 - by):
                rising, low = False, (at, x)
                out.append((*high, "high"))
        elif rising and x > high[1]:
            high = (at, x)
        elif rising and x <= high[1] * (1 - by):
            out.append((*high, "high"))
            rising, low = False, (at, x)
        elif not rising and x < low[1]:
            low = (at, x)
        elif not rising and x >= low[1] * (1 + by):
            out.append((*low, "low"))
            rising, high = True, (at, x)
    if rising is not None:
        out.append((*high, "high") if rising else (*low, "low"))
    return out


def test_functions_in_sql(spark):
    register(spark)
    rng, rows = random.Random(6), []
    for k in ("a", "b", None):
        x = 100.0
        for t in range(300):
            x *= 1 + rng.gauss(0, 0.02)
            rows.append((k, t, None if rng.random() < 0.05 else x))
    spark.createDataFrame(rows, "k string, t long, x double").repartition(5).createOrReplaceTempView("prices")
    got = spark.sql("SELECT * FROM turning_points(0.05D, TABLE(SELECT k, t, x FROM prices) PARTITION BY k ORDER BY t)")
    assert got.columns == ["key", "at", "value", "kind"]
    want = [(k, *p) for k in ("a", "b", None) for p in zigzag([(t, x) for g, t, x in rows if g == k], 0.05)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 20
    with pytest.raises(Exception, match="swing"):
        spark.sql("SELECT * FROM turning_points(0D, TABLE(SELECT k, t, x FROM prices) PARTITION BY k ORDER BY t)").collect()
    m = spark.sql("SELECT k, weighted_median(x, CAST(t AS DOUBLE)) AS m FROM prices GROUP BY k").collect()
    for r in m:
        pairs = sorted((x, t) for g, t, x in rows if g == r.k and x is not None and t > 0)
        half, total = sum(t for _, t in pairs) / 2, 0
        for x, t in pairs:
            total += t
            if total >= half:
                break
        assert r.m == x
    assert spark.sql("SELECT weighted_median(CAST(NULL AS DOUBLE), 1D) AS m").first().m is None


def test_swings_of_zeros_negatives_and_nulls_equal_the_sql(spark, tmp_path):
    rng = random.Random(12)
    series = [[5.0, 0.0, 0.0, 3.0], [0.0, 0.0, 1.0], [-2.0, -2.5, -9.0, -1.0, 4.0], [None, 5.0, 1.0], [5.0, None, 1.0, 9.0], [1.0, float("nan"), 2.0, 0.5]]
    series += [[rng.choice([None, 0.0, 0.0, -1.0, -2.0, -2.5, 1.0, 1.5, 2.0, 3.0, 5.0]) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    rows = [(u, 100 * u + i, v) for u, values in enumerate(series) for i, v in enumerate(values)] + [(None, 10**6, 1.0), (None, 10**6 + 1, 9.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.value_swings(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["value_swings"]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 100
