"""Links and components of vectors against brute force, recall, hot groups and the bounds behind the probes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import near_vectors as m
from tidemill.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.95):
    size = max(len(v or []) for _, v, _ in rows)
    ids, x = [], []
    for i, v, _ in rows:
        v = [np.nan if c is None else c for c in v or []]
        fine = i is not None and v and np.isfinite(v).all() and any(v)
        ids.append(i)
        x.append(np.array(v + [0.0] * (size - len(v)), dtype=np.float32).astype(float) if fine else np.full(size, np.nan))
    x = np.array(x)
    with np.errstate(invalid="ignore"):
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        links = unit @ unit.T >= least
    np.fill_diagonal(links, False)
    top = list(range(len(ids)))
    find = lambda a: a if top[a] == a else find(top[a])
    for a, b in zip(*np.nonzero(links), strict=True):
        top[find(a)] = find(b)
    first = {}
    for a, i in enumerate(ids):
        if i is not None:
            first[find(a)] = min(first.get(find(a), i), i)
    return sorted(((i, int(links[a].sum()), None if i is None else first[find(a)], i is None or i == first[find(a)]) for a, i in enumerate(ids)), key=repr)


def table(seed, dim=12, n=250):
    rng = random.Random(seed)
    near = lambda v, e: [c * 3 + rng.gauss(0, e) for c in v]
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)], 0) for i in range(n)]
    rows += [(1000 + i, near(rows[3][1], 0.05), 1) for i in range(150)]  # one tight group
    rows += [(2000 + i, list(rows[5][1]), 1) for i in range(90)]  # exact copies
    rows += [(3000 + i, near(rows[i][1], rng.choice([0.1, 0.4, 0.9])), 1) for i in range(100)]  # pairs about the limit
    chain = rows[7][1]
    for i in range(40):  # each near the one before
        chain = [c + rng.gauss(0, 0.12) for c in chain]
        rows.append((4000 + i, chain, 2))
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * dim, 1), (5003, [float("nan")] * dim, 1), (5004, [1.0, None], 1), (5005, [float("inf")] * dim, 1), (None, rows[3][1], 1),
             (5006, [2.0], 1), (5007, [1.0], 1), (5008, [1e30] * dim, 1), (5009, [1e-30] * dim, 1), (3000, rows[8][1], 1), (6, rows[6][1], 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "cells", "block", "least"), [(1, None, 4096, 0.95), (2, 60, 16, 0.95), (3, 1, 50, 0.95), (4, 20, 64, 0.8)])
def test_against_brute_force(spark, monkeypatch, seed, cells, block, least):
    """No link is lost, whatever the number of lists and the size of blocks."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = table(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"x": F.lit("mine"), "cell": F.lit(1), "uid": F.lit(2), "n": F.lit(3), "h": F.lit(4)})
    got = m.dedup(df, cells=cells, least=least)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found, want = sorted(map(tuple, got.collect()), key=repr), brute(rows, least)
    # Rows that share an id share the component of either; their links are their own.
    assert [r for r in found if r[0] not in (3000, 6)] == [r for r in want if r[0] not in (3000, 6)]
    assert [r[:2] for r in found] == [r[:2] for r in want]


def test_codes_bound_their_error_and_forests_keep_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    q = m.Quantiser(x[:7], [rng.normal(size=(9, 2)) for _ in range(8)])
    cell = vectors.squared(x, q.centers).argmin(1)
    code, e = q.encode(x, cell)
    for c in range(7):
        some = cell == c
        far = np.sqrt(vectors.squared(x, x[some]))
        assert (np.abs(np.sqrt(q.lookup(x, c, code[some])) - far) <= e[some][None, :] + 1e-6).all()
    for p in (0.02, 0.2, 0.9):
        links = rng.random((40, 50)) < p
        a, b = m.forest(links, np.arange(40), np.arange(100, 150))
        assert len(a) <= 90

        def comps(pairs):
            top = {}
            find = lambda u: u if top.setdefault(u, u) == u else find(top[u])  # noqa: E731, B023
            for u, w in pairs:
                top[find(u)] = find(w)
            return {frozenset(u for u in top if find(u) == r) for r in {find(u) for u in top}}

        assert comps(zip(a, b, strict=True)) == comps([(i, 100 + j) for i, j in zip(*np.nonzero(links), strict=True)])


def test_a_group_of_near_copies_is_counted_not_compared(spark):
    """3,000 near copies of one vector: no visit of their list compares them, and all link with all."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=32)
    rows = [(i, (base + rng.normal(size=32) * 0.02).tolist(), 0) for i in range(3000)] + [(5000 + i, rng.normal(size=32).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    _, distinct = m.classes(df, "vec_id", "embedding")
    q = m.fit(distinct, 32, 0.95, None)
    placed = distinct.select("uid", "n", "x").mapInArrow(m._place(q, 32, np.arccos(0.95) / 2), "cell int, uid long, n long, x array<double>, code binary, e double, far double, core boolean")
    assert placed.where("core").count() >= 3000 and placed.where("core").groupBy("cell").count().agg(F.max("count")).first()[0] >= 2990
    got = m.dedup(df)
    assert got.where("vec_id < 5000 AND n_links = 2999 AND component_id = 0").count() == 3000
    assert got.where("kept").count() == 301


def test_scratch_tables_and_rounds_stay_in_proportion(spark, monkeypatch, tmp_path):
    """Vectors without clusters, all of which visit most lists: no table of visits is kept, and no round shuffles more than the table's rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[2900:] = x[:100] + rng.normal(size=(100, 32)).astype(np.float32) * 0.1
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    kept, planned = [], []
    monkeypatch.setattr(m, "keep", lambda df, name="table", sweep=True, f=m.keep: kept.append((name, f(df, name, sweep))) or kept[-1][1])
    monkeypatch.setattr(m, "ROUND", 100, raising=False)
    monkeypatch.setattr(vectors, "BLOCK", 1024)
    if hasattr(m, "rounds"):
        monkeypatch.setattr(m, "rounds", lambda *a, f=m.rounds: planned.append((a, f(*a))) or planned[-1][1])
    got = m.dedup(df)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert max(t.count() for name, t in kept if name in ("visits", "links")) <= 3000
    ((sizes, visits, block, most), found), = planned
    assert most == 3000 and len(found) > 3
    done = []
    for some in found:
        cost = [(end - at) * (visits[k] + -(-sizes[k] // pieces) * parts) for k, pieces, parts, at, end in some]
        assert sum(cost) <= most or len(cost) == 1 and some[0][4] - some[0][3] == 1
        done += [(k, p) for k, _, _, at, end in some for p in range(at, end)]
    assert sorted(done) == [(k, p) for k in range(len(sizes)) if visits[k] for p in range(-(-sizes[k] // block))]


def test_edges_of_blocks_shrink_to_a_forest():
    rng = np.random.default_rng(4)
    for n in (0, 10, 100, 400):
        a, b = rng.integers(0, 200, n), rng.integers(0, 200, n)
        child, root = m.spanning(a, b)
        top = dict(zip(child.tolist(), root.tolist(), strict=True))
        assert len(top) == len(child) and not set(top) & set(root.tolist())
        want = {i: {i} for i in {*a.tolist(), *b.tolist()}}
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            both = want[i] | want[j]
            for k in both:
                want[k] = both
        assert all(top.get(i, i) == min(s) for i, s in want.items())


def test_empty_tables(spark):
    assert m.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sorted(map(tuple, m.dedup(spark.createDataFrame([(2, None, 1), (1, [0.0], 1), (3, [1.0], 1)], SCHEMA)).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
