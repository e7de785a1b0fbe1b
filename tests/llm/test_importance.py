"""Gains, weights and the draw against brute force, for one order and for several."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import importance as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, low, high):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, orders, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = {}, {}
    for texts, counts in (([x for _, x in docs], s), (target, t)):
        for text in texts:
            for f in runs(text, *orders):
                counts[bucket(f)] = counts.get(bucket(f), 0) + 1
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (total_s + buckets) / ((s.get(b, 0) + 1) * (total_t + buckets))))
    out = []
    for i, text in docs:
        f = runs(text, *orders)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        out.append([i, len(runs(text, 1, 1)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(may[: len(may) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


def texts(seed):
    rng = random.Random(seed)
    words = ["Ärger", "alpha", "BETA", "x2", "ß", "漢字", "q"] + [f"w{i}" for i in range(60)]
    docs = [(i, rng.choice([" ", "-", "\n\t", "\x00"]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " .!\x7f{"), (None, " ".join(words)), (503, "İ K Å " * 20), (7, docs[7][1]), (8, docs[8][1]), (600, "long " * 60_000 + "tail")]
    return docs, [" ".join(rng.choice(words[:9]) for _ in range(20)) for _ in range(12)] + [None, ""]


@pytest.mark.parametrize(("orders", "buckets", "percent"), [((1, 1), 10_000, 10), ((1, 3), 500, 33), ((2, 2), 97, 100)])
def test_against_brute_force(spark, orders, buckets, percent):
    docs, target = texts(buckets)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({"words": F.lit("mine"), "bucket": F.lit(1), "row": F.lit(2), "_row": F.lit(3), "gain": F.lit(4)})
    got = m.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), orders=orders, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    found = sorted(map(tuple, got.collect()), key=repr)
    want = brute(docs, target, orders, buckets, 20, percent, m.SEED)
    # Repeated rows tie whole; either may come first.
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert sorted((r[5], r[0] or -1) for r in found if r[5]) == sorted((r[5], r[0] or -1) for r in want if r[5])


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert m.resample(none, some).count() == 0
    r = m.resample(some, none.select("text"), percent=100).first()
    assert r.rank == 1 and r.n_features == 40


def test_no_window_over_the_whole_table(spark):
    """One order needs no exchange of words: the plan of the weights has the sum by row alone."""
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    plan = m.weigh(df, m.gains(df, df.select("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("hashpartitioning") <= 2 and "SinglePartition" not in plan
