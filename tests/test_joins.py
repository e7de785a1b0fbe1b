import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemill.operators.joins import asof_backward, band_join
from tidemill.operators.quantiles import exact_quantile
from tidemill.plans.registry import events_by_day


def test_asof_against_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", None]), rng.randrange(50)) for i in range(60)]
    right = [(rng.choice(["a", "b", None]), rng.randrange(50), rng.randrange(9)) for _ in range(40)]
    out = asof_backward(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "k", "t", ["t", "v"])
    for r in out.collect():
        best = max(((t, v) for k, t, v in right if k is not None and k == r.k and t <= r.t), default=(None, None))
        assert (r.asof_t, r.asof_v) == best
    assert out.count() == len(left)


def test_band_join_against_brute_force(spark):
    rng = random.Random(2)
    left = [(i, rng.choice([None, *range(-20, 40)])) for i in range(50)]
    right = [(i, lo, None if i == 3 else lo + rng.randrange(-2, 15)) for i, lo in enumerate(rng.randrange(-20, 40) for _ in range(30))]
    got = band_join(spark.createDataFrame(left, "id int, x int"), spark.createDataFrame(right, "b int, lo int, hi int"), "x", "lo", "hi", 4).select("id", "b").collect()
    want = [(i, b) for i, x in left for b, lo, hi in right if x is not None and hi is not None and lo <= x <= hi]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("p", [0.0, 0.37, 0.5, 1.0])
def test_exact_quantile_against_brute_force(spark, p):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random(), rng.randrange(5) / 1.0])) for _ in range(3000)] + [("c", None), ("d", 2.5)]
    got = {r.k: r.quantile for r in exact_quantile(spark.createDataFrame(rows, "k string, v double"), "k", "v", p, accuracy=50).collect()}
    assert set(got) == {"a", "b", "c", "d", None} and got["c"] is None and got["d"] == 2.5
    for k in ("a", "b", None):
        v = sorted(x for g, x in rows if g == k and x is not None)
        at = p * (len(v) - 1)
        assert got[k] == pytest.approx(v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at)), abs=1e-12)
        assert p != 0.5 or got[k] == pytest.approx(statistics.median(v))


def test_quantile_of_a_value_that_most_rows_share(spark):
    """The window ranks distinct values, not the rows that share one."""
    df = spark.range(0, 40_000, 1, 4).select(F.lit("k").alias("k"), F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = exact_quantile(df, "k", "v", 0.5)
    assert got.first().quantile == 5.0
    assert "row_number" not in got._jdf.queryExecution().toString()


def test_days_do_not_depend_on_the_session_zone(spark, sf_dir):
    here = sorted(map(tuple, events_by_day(spark, sf_dir).collect()))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(tuple, events_by_day(spark, sf_dir).collect())) == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
