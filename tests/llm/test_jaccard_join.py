import random
import re

import numpy as np
import pytest

from tidemill.llm import jaccard_join as j
from tidemill.llm.components import components

LOW = {i: i + 32 for i in range(65, 91)}


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


def test_shingles_equal_brute_force():
    for t in (None, "", " \n", "a", "A b\tC\x0bd", "a b c d e", "É é A\xa0b c d e f g a A\xa0b c d e f", "x " * 500, "😀 b c d e 😀 b c d e"):
        assert len(j.shingles(t)) == len(sets(t)), t
    assert np.array_equal(j.shingles("The CAT sat"), j.shingles("the  cat\nsat"))
    assert j.class_id(j.shingles("a b")) != j.class_id(j.shingles("a c"))


def test_prefixes_share_enough_matches():
    rng = random.Random(7)
    tokens = np.sort(np.array(rng.sample(range(4000), 200), dtype=np.uint64))
    counts = np.array([rng.randrange(4, 99) for _ in tokens])
    seen = hot = 0
    for _ in range(3000):
        a = np.array(sorted(rng.sample(range(4000), rng.randrange(1, 60))), dtype=np.uint64)
        if rng.random() < 0.5:
            a = np.unique(np.concatenate([a, tokens[: rng.randrange(150)]]))
        b = np.array([x for x in a if rng.random() < 0.93], dtype=np.uint64)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            p, q = j.prefix(a, tokens, counts), j.prefix(b, tokens, counts)
            x, y = list(p.tokens), list(q.tokens)
            shared = [t for t in x if t in y]
            assert len(shared) >= min(p.k, q.k)
            assert all(x.index(t) < p.front or y.index(t) < q.front for t in shared[: min(p.k, q.k)])
            counted = sum(x.index(t) < p.cold for t in shared)
            assert both <= counted + max(len(a) - p.cold, len(b) - q.cold)
            seen += 1
            hot += p.cold < len(x)
    assert seen > 500 and hot > 100


def test_templates_give_no_pairs(spark):
    """Texts of one template, 84 of 100 words, don't link; copies of some do. No pair of the template's lists is built."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    template = [word() for _ in range(84)]
    rows = [(i, " ".join([*template, *(word() for _ in range(16))])) for i in range(10_000)]
    rows += [(20_000 + i, f"{t} {word()}") for i, t in rows[:50]]
    got = {r.doc_id: r.component_id for r in j.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 20_000 if i >= 20_000 else i for i, _ in rows}


def test_one_id_with_two_texts_and_a_carried_column(spark):
    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l", "y"), (2, "A b c d e f", "z"), (3, "g h i j k l", None)]
    got = {(r.doc_id, r.mark): r for r in j.join(spark.createDataFrame(rows, "doc_id long, text string, mark string"), carry=("mark",)).collect()}
    assert got[1, "x"].component == got[2, "z"].component != got[1, "y"].component == got[3, None].component
    assert {r.component_id for r in got.values()} == {1}


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    whole = j.class_id
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "g h i j k l")]
    entries = spark.createDataFrame([(i, 7, whole(j.shingles(t), 2), 2, 2, 2) for i, t in rows], "doc_id long, cid long, check long, n long, k long, cold long")
    named, classes = j._grouped(entries)
    got = {r.doc_id: r.cid for r in named.collect()}
    assert got[1] == got[2] != got[3] and {(r.cid, r.rep) for r in classes.collect()} == {(got[1], 1), (got[3], 3)}


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoin") for _ in range(4)) for _ in range(400)]
    rows, at = [], 0
    shared = [rng.choice(words) for _ in range(30)]
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 150]))]
        if rng.random() < 0.3:
            base = base[:10] + shared
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(words).upper()
            rows.append((at, " ".join(t)))
            at += rng.randrange(1, 5)
    return rows


@pytest.mark.parametrize("hot", [2, 5, 32])
def test_join_equals_brute_force(spark, hot):
    rows = [*made(8 + hot), (5000, None), (5001, ""), (5002, " \t"), (5003, "one two"), (5004, "ONE  two"), (5005, "long " * 30_000), (5006, "long " * 5)]
    df = spark.createDataFrame([*rows, (None, "one two"), (5003, "one two")], "doc_id long, text string").selectExpr("*", "1 AS token", "2 AS cid")
    got = j.join(df, hot=hot).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert (r.n_shingles, r.component_id) == (1, None)
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert j.join(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
