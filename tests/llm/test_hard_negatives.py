"""Mined negatives against brute force: ties, copies, nulls, windows, ragged vectors, many lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.llm import hard_negatives as m
from tidemill.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, every, positives=5, negatives=3):
    fine = [(i, lab, [math.floor(256 * f32(c)) for c in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(v) for _, _, v in fine), default=0)
    fine = [(i, lab, v + [0] * (size - len(v))) for i, lab, v in fine]
    anchors = {}
    for i, lab, v in fine:
        if i % every == 0 and (i not in anchors or (lab, v) < anchors[i]):
            anchors[i] = (lab, v)
    out = []
    for a, (lab, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, l2) for i, l2, v in fine if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            near = [(n, -t) for t, n, l2 in scored if l2 != lab and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, r, n, -s, t) for r, (n, t) in enumerate(near, 1)]
    return sorted(out)


def table(seed, n=400, dim=6, spread=0.3):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = rng.randrange(8)
        rows.append((i, [rng.gauss(x, spread) for x in middles[c]], c % 5))
    copy = rows[20][1]
    rows += [(1000 + i, list(copy), i % 3) for i in range(150)]  # a third of equal vectors under several labels
    rows += [(2000, [1.0] * dim, None), (2010, None, 1), (2020, [1.0, None], 1), (2030, [float("nan")] * dim, 1), (2040, [float("inf")] * dim, 1), (None, [1.0] * dim, 1),
             (2050, [], 1), (2060, [1.0, 2.0], 2), (2070, [0.0] * dim, 3), (2080, [-1.0] * dim, 77)]
    return rows


@pytest.mark.parametrize(("seed", "cells", "block"), [(1, None, 4096), (2, 40, 16), (3, 1, 64)])
def test_against_brute_force(spark, monkeypatch, seed, cells, block):
    """Also with lists cut in many small blocks, and with many lists visited in several rounds."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = table(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"q": F.lit("mine"), "cell": F.lit(1), "id": F.lit(2)})
    got = m.mine(df, lambda i: i % 10 == 0, cells=cells)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_repeated_rows_of_an_anchor(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.0, 1.0], 2), *[(i, [1.0 - i / 50, i / 50], i % 2) for i in range(1, 20)]]
    got = m.mine(spark.createDataFrame(rows, SCHEMA), lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_lists_are_skipped_and_searches_stop(spark):
    """Tight, far groups: an anchor visits few lists after the first round, none of those whose bound is too low."""
    rng = random.Random(5)
    rows = [(g * 100 + i, [10.0 * (g == j) + rng.gauss(0, 0.01) for j in range(30)], i % 2) for g in range(30) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, size = m.whole(df, "vec_id", F.col("label"), "embedding", 256)
    lists = m.index(whole, size, 30)
    run = m._visits(lists.centers, lists.radius, 0, 30)
    asked = lists.rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "label", "q", F.expr(f"array(named_struct('w', 0, 'lo', -{m.OPEN}L, 'hi', {m.OPEN}L, 'kth', 6000000L))").cast(m._WINDOWS).alias("windows"))
    n = asked.mapInArrow(run, f"cell int, qid long, label long, q array<double>, windows {m._WINDOWS}").count()
    assert asked.count() <= n <= 4 * asked.count()  # of thirty lists
    got = m.mine(df, lambda i: i % 50 == 0, cells=30)
    assert sorted(map(tuple, got.collect())) == brute(rows, 50)


def test_empty_tables_and_lone_anchors(spark):
    assert m.mine(spark.createDataFrame([], SCHEMA), lambda i: i % 10 == 0).count() == 0
    assert m.mine(spark.createDataFrame([(10, [1.0], 1)], SCHEMA), lambda i: i % 10 == 0).count() == 0
    assert m.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], SCHEMA), lambda i: i % 10 == 0).count() == 0
