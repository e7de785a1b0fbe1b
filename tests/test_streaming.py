"""The event-time jobs give streams what they give a batch."""

import pytest
from pyspark.sql import functions as F

from tidemill.sources.tables import table, write_partitioned
from tidemill.streaming.windows import event_time, sessions, tumbling


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return event_time(table(spark, sf_dir, "events"))


def streamed(spark, df, tmp_path, job, name):
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = job(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    return spark.table(name)


def test_tumbling_stream_equals_batch(spark, events, tmp_path):
    job = lambda df: tumbling(df, "ts", "1 day", "40 days", "event_type").select("w.start", "event_type", "n", F.round("total", 4).alias("total"))
    got = streamed(spark, events, tmp_path, job, "tumbling_out")
    want = job(events)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_sessions_stream_equals_batch(spark, events, tmp_path):
    job = lambda df: sessions(df, "ts", "30 minutes", "40 days", "user_id").select("w.start", "user_id", "n")
    few = events.where("user_id < 8")
    got = streamed(spark, few, tmp_path, job, "sessions_out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, job(few).collect())) and got.count() > 10


def test_partitioned_write_round_trip(spark, sf_dir, tmp_path):
    orders = table(spark, sf_dir, "orders")
    write_partitioned(orders, f"{tmp_path}/o", "o_orderstatus")
    back = spark.read.parquet(f"{tmp_path}/o")
    assert back.select(*orders.columns).exceptAll(orders).count() == 0 and back.count() == orders.count()
