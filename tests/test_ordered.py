"""Windows cut in segments against plain windows, with half the rows in one key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.joins import asof_backward
from tidemill.operators.ordered import SEGMENT, carried, cut, moving, sessions


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    t0 = datetime(2024, 1, 1)
    out = [(i, rng.choice(["hot"] * 6 + [None, "a", "b", "c", "d", "e"]), rng.randrange(40_000), rng.choice([None, None, None, rng.randrange(100)])) for i in range(6000)]
    return spark.createDataFrame([(i, k, t0 + timedelta(seconds=30 * t), v) for i, k, t, v in out], "id int, k string, t timestamp_ntz, v int").repartition(5)


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(*got.columns).collect()), key=repr)


def test_no_segment_holds_the_hot_key(rows):
    sizes = [r["count"] for r in cut(rows, "k", ["t", "id"], 12).groupBy("k", SEGMENT).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1200


@pytest.mark.parametrize("parts", [1, 3, 12, 40])
def test_carried_values(rows, parts):
    w = W.partitionBy("k").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    same(carried(cut(rows, "k", ["t", "id"], parts), "k", ["t", "id"], "v", "seen"), rows.withColumn("seen", F.last("v", ignorenulls=True).over(w)))


@pytest.mark.parametrize(("parts", "preceding"), [(1, 2), (12, 2), (12, 9), (40, 2), (60, 300)])
def test_moving_sums(rows, parts, preceding):
    """Also with more preceding rows than a segment has."""
    some = rows.where("id < 3000")
    w = W.partitionBy("k").orderBy("t", "id").rowsBetween(-preceding, 0)
    same(moving(cut(some, "k", ["t", "id"], parts), "k", ["t", "id"], preceding, "s", F.sum("v")), some.withColumn("s", F.sum("v").over(w)))


@pytest.mark.parametrize(("parts", "gap"), [(1, "5 minutes"), (12, "5 minutes"), (40, "2 minutes"), (40, "2 days")])
def test_sessions(rows, parts, gap):
    """The longest gap makes one session of a key over all its segments."""
    want = rows.where("k IS NOT NULL").groupBy("k", F.session_window("t", gap).alias("w")).agg(F.max("t").alias("ended"), F.count("*").alias("n")).select("k", F.col("w.start").alias("began"), "ended", "n")
    same(sessions(cut(rows.where("k IS NOT NULL"), "k", ["t", "id"], parts), "k", "t", gap), want)


@pytest.mark.parametrize("parts", [3, 20])
def test_asof_join_cut_in_segments(rows, parts):
    left, right = rows.where("id % 3 > 0").select("id", "k", "t"), rows.where("id % 3 = 0").select("k", "t", "v")
    same(asof_backward(left, right, "k", "t", ["t", "v"], parts=parts), asof_backward(left, right, "k", "t", ["t", "v"]))


def test_empty(spark):
    none = spark.createDataFrame([], "id int, k string, t timestamp_ntz, v int")
    rows = cut(none, "k", ["t"], 3)
    assert carried(rows, "k", ["t"], "v", "s").count() == moving(rows, "k", ["t"], 2, "s", F.sum("v")).count() == sessions(rows, "k", "t", "1 minute").count() == 0
