import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import toxicity as t
from tidemill.llm.common import remainder
from tidemill.llm.registry import op5_toxicity


def test_label_model_recovers_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    n, toxic = 6000, np.array([0.7, 0.6, 0.5, 0.5])
    y = rng.random(n) < 0.2
    fire = rng.random((n, 4)) < np.where(y[:, None], toxic, 0.02)
    fire = np.column_stack([fire, fire[:, 3]])  # a voter and its twin
    m = t.LabelModel(np.full(5, 0.4), np.full(5, 0.1), 0.3)
    for _ in range(15):
        p = m.posterior([list(np.flatnonzero(f)) for f in fire])
        pairs = np.stack([(fire * q[:, None]).T @ fire for q in (p, 1 - p)])
        n, (i, j) = np.array([p.sum(), (1 - p).sum()]), np.triu_indices(5, 1)
        m.refit(np.stack([np.diag(x) for x in pairs]), n)
        m.reweigh(m.correlated(i, j, pairs[0][i, j], n[0]))
    assert np.allclose(m.toxic[:3], toxic[:3], atol=0.08) and abs(m.prior - 0.2) < 0.04
    assert m.weight[3] == pytest.approx(0.5, abs=0.1) and m.weight[0] > 0.7


def test_logistic_regression_fits():
    rng = random.Random(2)
    rows, y = [], []
    for _ in range(800):
        r = [j for j in range(6) if rng.random() < 0.3]
        rows.append(r)
        y.append(float(0 in r or (1 in r and 2 in r)))
    w, b = t.fit_logistic(rows, np.array(y), 6)
    p = np.array([b + w[r].sum() for r in rows])
    assert np.mean((p > 0) == np.array(y)) > 0.95 and abs(w[4]) < 1 < w[0]


def test_numbers_of_voters(spark):
    lexicon = t.Lexicon({"worm": 0, "vile*": 1, "crook": 2}, (1, 1), 2)
    docs = spark.createDataFrame([(1, "you are a WORM, vilest"), (2, "crook!!"), (3, None), (4, "worm worm")], "doc_id long, text string")
    got = {r.doc_id: (r.found, sorted(r.v)) for r in t.find(docs, lexicon).select("*", t.voices(F.col("found"), lexicon).alias("v")).collect()}
    assert got[1] == ([0, 1, 4, 8, 10], [0, 1, 3, 7])  # both words vote; second-person address
    assert got[2] == ([2, 7, 9], [2, 6])  # its only word has no vote; marks
    assert got[3] == ([3, 9], [2]) and got[4] == ([0], [0])


def test_rounds_with_a_thousand_voters_equal_dense_tables(spark, monkeypatch):
    """No voter is cut, and sums sent in many parts, also amid a text, are those of the whole tables."""
    monkeypatch.setattr(t, "PAIRS", 500)
    rng = np.random.default_rng(3)
    size, n = 1_000, 400
    y = rng.random(n) < 0.3
    fire = rng.random((n, size)) < np.where(y[:, None], 0.04, 0.01)
    fire[0, :300] = True  # one very long text
    fire[1] = False
    known = [None if rng.random() < 0.5 else int(v) for v in y]
    rows = [([int(v) for v in np.flatnonzero(f)], k, int(c)) for f, k, c in zip(fire, known, rng.integers(1, 4, n), strict=True)]
    patterns = spark.createDataFrame(rows, "fired array<long>, y int, n long").repartition(3)
    got, want = (t.LabelModel(np.full(size, 0.05), np.full(size, 0.02), 0.25) for _ in range(2))
    x, count = fire.astype(float), np.array([c for *_, c in rows], float)
    for _ in range(3):
        t._refit(patterns, got)
        p = want.posterior([f for f, *_ in rows])
        p = np.array([q if k is None else k for q, k in zip(p, known, strict=True)])
        shares = np.stack([count * p, count * (1 - p)])
        rate = [(s @ x + c) / (s.sum() + 1) for s, c in zip(shares, (0.01, 0.001), strict=True)]
        want.toxic, want.clean, want.prior = *(np.clip(r, 1e-6, 1 - 1e-6) for r in rate), shares[0].sum() / count.sum()
        a = want.toxic
        corr = ((x * shares[0][:, None]).T @ x / shares[0].sum() - np.outer(a, a)) / np.sqrt(np.outer(a * (1 - a), a * (1 - a)))
        corr = np.clip(corr, 0, 1)
        np.fill_diagonal(corr, 0)
        want.weight = 1 / (1 + corr.sum(axis=1))
        for name in ("toxic", "clean", "prior", "weight"):
            assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-8), name


def test_entries_and_voters_are_in_shares_of_the_toxic_texts(spark, monkeypatch):
    rows = [(i, "calm day") for i in range(40)] + [(100 + i, f"vile{' odd' if i < 6 else ''}") for i in range(30)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    found = lambda: (lambda x: (list(x.index), x.voters))(t.learn(docs, labels))
    assert found() == (["vile", "odd"], 2)
    monkeypatch.setattr(t, "COVERAGE", 0.25)
    assert found() == (["vile", "odd"], 1)
    monkeypatch.setattr(t, "SHARE", 0.25)
    assert found() == (["vile"], 1)


def test_no_number_of_voters_is_set(spark):
    spell = lambda k: "".join(chr(97 + int(c)) for c in f"{k:03d}")
    some = [spell(k) for k in range(400)]
    rows = [(i, "calm day") for i in range(60)] + [(100 + i, " ".join(some)) for i in range(8)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    model = t.train(docs, labels)
    assert set(model.index) == set(some) and model.lexicon.voters == 400
    assert {r.doc_id for r in t.score(docs, model).where("score >= 0.5").collect()} == set(range(100, 108))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "you vile worm", 5), (3, "you vile worm", 5), (None, "fine day " * 50_000, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = t.train(docs, none)
    assert {round(r.score, 6) for r in t.score(docs, m).collect()} == {0.0}
    more = [(100 + i, f"you vile worm {'xy'[i % 2]}", 5) for i in range(20)] + [(200 + i, f"a calm and fine day {'xy'[i % 2]}", 5) for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, score int"))
    labels = spark.createDataFrame([(3, 1), (2, 0), (1, None), (99, 1), *((i, int(i < 200)) for i, _, _ in more)], "doc_id long, toxic int")
    m = t.train(docs, labels)
    got = {r.doc_id: r.score for r in t.score(docs, m).collect()}
    assert got[3] > 0.5 > got[2] == got[1] and got[None] < 0.5 and all(0 <= x <= 1 for x in got.values())
    assert t.score(docs.limit(0), m).count() == 0 and t.train(docs.limit(0), labels).index == {}


def test_rare_toxic_words_are_compared_behind_many_frequent_ones(spark):
    spell = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    ordinary = " ".join(f"{spell(k)}k" for k in range(20_500))  # in every text, so more frequent than any toxic word
    rows = [(i, ordinary) for i in range(30)] + [(100 + i, f"{ordinary}{' zzqy' if i < 6 else ''}") for i in range(12)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    lexicon = t.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels)
    assert list(lexicon.index) == ["zzqy"] and lexicon.labelled == (30, 12)


def test_counts_of_clean_and_toxic_texts(spark, monkeypatch):
    texts = [("vile worm worm", 1), ("worms", 1), ("a worm", 0), ("Worm", 0), ("odd", 2)]
    monkeypatch.setattr(t, "ROOM", 3)
    got = {r.token: (r.n0, r.n1) for r in t._counted(spark.createDataFrame(texts, "text string, y int")).collect()}
    assert got == {"vile": (0, 1), "worm": (2, 1), "worms": (0, 1), "worm*": (0, 1), "a": (1, 0)}


def test_lexicon_and_scores_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "YOU ARE !!! LOUD WORDS")]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = t.train(docs, labels)
    words = {i: set(re.findall(r"[^\W\d_]+", (x or "").lower())) for i, x in rows}
    tokens = {i: {z for w in ws for z in (w, *(w[:k] + "*" for k in range(4, 9) if len(w) > k))} for i, ws in words.items()}
    n = [sum(marks.get(i) == y for i, _ in rows) for y in (0, 1)]
    count = [Counter(z for i, zs in tokens.items() if marks.get(i) == y for z in zs) for y in (0, 1)]
    ratio = {z: math.log((c + 0.5) / (n[1] + 1)) - math.log((count[0][z] + 0.5) / (n[0] + 1)) for z, c in count[1].items() if c >= t.LEAST}
    telling = {z: r for z, r in ratio.items() if r > t.LIFT}
    assert model.lexicon.labelled == tuple(n) and set(model.index) == set(telling) and len(telling) > 5
    order = [telling[z] * math.sqrt(count[1][z]) for z in model.index]
    assert all(a >= b - 1e-9 for a, b in zip(order, order[1:], strict=False))
    got = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    entries = list(model.index)
    for i, x in rows:
        loud = sum(any(z in telling for z in (w, *(w[:k] + "*" for k in range(4, 9) if len(w) > k))) for w in words[i])
        extra = [loud == 0, loud > 1, loud > 2, *(bool(pattern.search(x or "")) for _, pattern in t.PATTERNS)]
        z = model.bias + sum(w for w, e in zip(model.weights, [*(e in tokens[i] for e in entries), *extra], strict=True) if e)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.1")  # enough positives to measure on
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = op5_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    pos, neg = got.score[got.toxic == 1], got.score[got.toxic == 0]
    auc = np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos])
    assert auc > 0.85 and (got.predicted == (got.score >= 0.5)).all()
    assert (got.predicted[got.toxic == 0] == 1).mean() < 0.05
    held = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (remainder("doc_id", 5) == 0).alias("h"))
    assert op5_toxicity(spark, sf_dir).join(held, "doc_id").where(F.col("h") != F.col("held_out")).count() == 0
