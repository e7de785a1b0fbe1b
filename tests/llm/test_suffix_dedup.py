import hashlib
import random

import numpy as np
import pytest

from tidemill.llm import suffix_dedup as d
from tidemill.llm.registry import op3_suffix_dedup


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for s in range(len(t) - width + 1):
            seen[t[s : s + width]] = seen.get(t[s : s + width], 0) + 1
    out = []
    for t in data:
        gone = [False] * len(t)
        for s in range(len(t) - width + 1):
            if seen[t[s : s + width]] > 1:
                gone[s : s + width] = [True] * width
        out.append((bytes(c for c, g in zip(t, gone, strict=True) if not g), len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return out


def made(seed, width):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "é", "漢字", "of", "river", "stone", "x"]) + rng.choice(" ,.\n") + rng.choice(["", "a", "bb"])
    text = lambda n: "".join(word() for _ in range(n))
    passages = [text(rng.randrange(20, 90)) for _ in range(6)]
    texts = [None, "", "short", "ab" * 300, "z" * (width - 1), "z" * width, "z" * (width + 5)]
    for _ in range(60):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(len(p))], text(rng.randrange(40))]
        texts.append("".join(parts))
    return [*texts, texts[20], texts[20], texts[21][5:], texts[22][:-9] + "q" + texts[22][-9:]]


def test_anchors_move_with_their_windows():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abc") for _ in range(3000)) + b"k" * 400
    place, _, first, last = d.anchors(data, 50, 16)
    assert first[0] == 0 and last[-1] == len(data) - 50 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place + 16 <= first + 50)).all()
    p2, _, f2, l2 = d.anchors(b"some other head" + data, 50, 16)
    where = {s: p - s for p, a, b in zip(place, first, last, strict=True) for s in range(a, b + 1)}
    assert all(p - s == where[s - 15] for p, a, b in zip(p2, f2, l2, strict=True) for s in range(a, b + 1) if s >= 15)


def test_loser_tree_merges_and_keeps_shared_prefixes():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))), (bytes(3), 1, 2, 3, i)) for i in range(rng.randrange(60))) for _ in range(k)]
        got = list(d.merge([d.decoded(*d.front_coded(r)) for r in runs]))
        assert [s for _, s, _ in got] == sorted(s for r in runs for s, _ in r)
        assert all(h == d.common(a[1], s) for a, (h, s, _) in zip(got, got[1:], strict=False))
        assert sorted(p for _, _, p in got) == sorted(p for r in runs for _, p in r)
    assert list(d.merge([])) == []


@pytest.mark.parametrize(("per_range", "fan"), [(7, 4), (7, 512), (100_000, 512)])
def test_dedup_equals_brute_force(spark, per_range, fan):
    """With ranges in one level or in several, with hot grams of several ranges, and in one range."""
    for seed, width, gram in ((3, 60, 16), (4, 200, 64)):
        texts = made(seed, width)
        df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS did", "2 AS spans").repartition(5)
        got = sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in d.dedup(df, width=width, gram=gram, per_range=per_range, fan=fan).collect()), key=repr)
        want = sorted(((i if i % 9 else None, *b) for i, b in enumerate(brute(texts, width))), key=repr)
        assert got == want
        assert sum(w[3] for w in want) > 2000


@pytest.mark.parametrize("size", [1, 16])
def test_slots_that_grams_share_change_nothing(spark, monkeypatch, size):
    """Tables so small that every gram gets the ranges of the largest, or many do."""
    monkeypatch.setattr(d, "SLOTS_LEAST", 1)
    monkeypatch.setattr(d, "SLOTS_MOST", size)
    texts = made(5, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in d.dedup(df, width=60, gram=16, per_range=5, fan=8).collect()}
    assert got == dict(enumerate(brute(texts, 60)))


def test_ranges_of_a_gram_are_enough(spark):
    """The lesser slot is never below what a gram needs; without hot grams all slots are 0."""
    rng = random.Random(8)
    grams = [(rng.getrandbits(64) - (1 << 63), rng.choice([2, 9, 10, 11, 80, 81, 5000])) for _ in range(400)]
    df = spark.createDataFrame(grams, "h long, n long").repartition(3)
    tables = d._ranges(df, 10)
    for h, n in grams:
        order = int(d._mixed(np.array([h], dtype=np.int64).view(np.uint64) + np.uint64(3))[0])
        log = min(t[s] for t, s in zip(tables, d._slots(order, len(tables[0])), strict=True))
        assert (1 << log) * 10 >= n and (n > 10 or log == 0 or log <= 9)
    assert not any(map(any, d._ranges(df, 10_000)))


def test_empty_table(spark):
    assert d.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r.doc_id: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (kept, n, gone, spans) in zip(rows, brute([r.text for r in rows], 200), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_dedup(spark, sf_dir).collect()}
    assert got == want
