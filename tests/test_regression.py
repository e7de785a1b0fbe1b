"""Least squares against numpy, on columns with means of 10^9, where sums of squares would keep no digit of the spread; merged states; groups that can't be solved."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators.regression import linear, merged, moments, solve

XS = ["a", "b", "c"]


def table(n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        g = rng.choice(["g", "h", None])
        x = [1e9 + rng.gauss(0, 1), rng.gauss(5, 2), float(rng.randrange(4))]
        rows.append((g, None if i % 50 == 7 else 3 + 2 * (x[0] - 1e9) - x[1] + 0.5 * x[2] + rng.gauss(0, 0.1), *x))
    return rows + [("few", 1.0, 1.0, 2.0, 3.0), ("flat", 1.0, 2.0, 2.0, 3.0), *[("twice", float(i), float(i * i), 2.0 * i * i, float(i % 3)) for i in range(9)], ("g", float("nan"), 1.0, 1.0, 1.0)]


SCHEMA = "g string, y double, a double, b double, c double"


def check(found, rows):
    got = {(r.g, r.term): r for r in found.collect()}
    assert len(got) == 4 * len({r[0] for r in rows})
    for g in ("g", "h", None):
        x = np.array([r[2:] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]])
        y = np.array([r[1] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]])
        near = np.column_stack([np.ones(len(x)), x - x.mean(axis=0)])
        b, left, *_ = np.linalg.lstsq(near, y, rcond=None)
        s2 = left[0] / (len(x) - 4)
        cov = s2 * np.linalg.inv(near.T @ near)
        for i, name in enumerate(XS):
            r = got[g, name]
            assert r.coef == pytest.approx(b[i + 1], rel=1e-5) and r.se == pytest.approx(cov[i + 1, i + 1] ** 0.5, rel=1e-5)
            assert r.n == len(x) and r.s2 == pytest.approx(s2, rel=1e-5) and 0.99 < r.r2 < 1
        assert got[g, "intercept"].coef == pytest.approx(b[0] - b[1:] @ x.mean(axis=0), rel=1e-5)
    for g in ("few", "flat", "twice"):
        assert all(got[g, t].coef is None and got[g, t].se is None for t in ("intercept", *XS))


def test_against_numpy(spark):
    rows = table()
    check(linear(spark.createDataFrame(rows, SCHEMA), "g", "y", XS), rows)


def test_states_of_parts_merge(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    part = F.pmod(F.hash("y"), F.lit(3))
    parts = [moments(df.where(part == i), "g", "y", XS) for i in range(3)] + [moments(df.where(part.isNull()), "g", "y", XS)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    check(solve(merged(both), XS).withColumnRenamed("key", "g"), rows)


def test_empty(spark):
    assert linear(spark.createDataFrame([], SCHEMA), "g", "y", XS).count() == 0
