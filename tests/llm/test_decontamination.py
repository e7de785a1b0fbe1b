import random

import numpy as np

from tidemill.llm import decontamination as d
from tidemill.llm.registry import op10_decontamination


def brute(item, text):
    """Least edit distance of item to any substring, by the textbook table."""
    row = [0] * (len(text) + 1)
    for a in item:
        last, row = row, [row[0] + 1]
        for j, b in enumerate(text):
            row.append(min(last[j] + (a != b), last[j + 1] + 1, row[j] + 1))
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(3)
    for _ in range(400):
        item = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 120)))
        assert d.myers(item, text)[0] == brute(item, text)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], ["z"], [s[i], "q"]])
    return "".join(s)


def test_matcher_equals_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoins") for _ in range(rng.randrange(1, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 25)))) for i in range(30)]
    m = d.Matcher(items, 0.1)
    for _ in range(150):
        text = " ".join([*(word() for _ in range(30)), edited(rng, rng.choice(items)[1], rng.randrange(0, 12)), *(word() for _ in range(30))])
        text = text.upper().replace(" ", "  \n", 5)
        got = {h["item_id"]: h["distance"] for h in m.hits(text)}
        want = {i: x for i, t in items if (x := brute(t, d.fold(text))) <= int(0.1 * len(t))}
        assert got == want
        for h in m.hits(text):
            item = dict(items)[h["item_id"]]
            assert brute(item, d.fold(text[h["start"] : h["end"]])) == h["distance"]


def test_operator(spark):
    items = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta"), (1, "Alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "one two three four five six")], "item_id long, text string")
    rows = [(10, "xx ALPHA  beta\tgamma delta epsilon zeta yy"), (10, "xx ALPHA  beta\tgamma delta epsilon zeta yy"), (11, None), (12, ""), (13, "İ alpha betta gamma delta epsilon zeta"), (14, "clean text"), (None, "one two three four five six " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS item_id", "'x' AS leaks")
    for block in (10, 10_000):
        got = sorted(((r.doc_id, r.item_id, r.distance, r.start, r.end) for r in d.leaks(docs, items, block_chars=block).collect()), key=repr)
        assert got == sorted([(10, 1, 0, 3, 39)] * 4 + [(13, 1, 1, 2, 38)] * 2 + [(None, None, 0, 0, 27)], key=repr)
    assert d.leaks(docs, items.limit(0)).count() == 0 and d.leaks(docs.limit(0), items).count() == 0
    assert d.flag(docs, items).columns == ["doc_id", "text", "item_id", "leaks"]


def least(item, codes):
    """``brute`` with a row of the table at once: what comes from the left is a running minimum."""
    at = np.arange(len(codes) + 1)
    row = np.zeros(len(codes) + 1, dtype=np.int64)
    for n, a in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(a)))
        row = np.minimum.accumulate(np.concatenate([[n], new]) - at) + at
    return int(row.min())


def test_query_on_a_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    rng = random.Random(1)
    for _ in range(50):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        assert least(x, np.array(list(map(ord, y)))) == brute(x, y)
    want = {}
    for r in docs:
        text = np.array(list(map(ord, d.fold(r.text))), dtype=np.int64)
        for i in items:
            item = d.fold(i.text)
            if (x := least(item, text)) <= int(d.RATE * len(item)):
                want[r.doc_id, i.item_id] = x
    got = {(r.doc_id, r.item_id): r.distance for r in op10_decontamination(spark, sf_dir).collect()}
    assert got == want and want
