import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import quality as q
from tidemill.llm.registry import op9_quality_rules

STEPS = 5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "a a a a a a a a a a a a", "x\ny\nx\n\n \nx \ny", "#tag $5 a|b <i> 100% & *", "é 漢字 😀 " * 9, "a\x0bb\x0cc\rd\te f\xa0g h",
    "w1 w2 w3 w4 w5 w6 " * 2 + "z", " ".join(f"w{i % 997}" for i in range(20_000)), "line\n" * 5000,
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(["a ", "b ", "c\n", "#", "é", " \t"]) for _ in range(rng.randrange(200))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n_words", "2 AS d2")
    got = q.judge(df, steps=2).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), repr(texts[r.doc_id])[:80]
        assert not (r.kept and r.base_failed)


def test_outliers_of_their_source_go(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(80, 400))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(words) + "###" for _ in range(200)), "en", "s") for i in range(40)]
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(100)), None, None) for i in range(3)]
    got = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and all(got[2000 + i] for i in range(3))
    assert not any(got[1000 + i] for i in range(40))


def test_each_repeat_statistic_can_reject(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, "\n".join(line(10) for _ in range(rng.randrange(8, 40))), "en", "s") for i in range(300)]
    rows += [(1000 + i, "\n".join(f"{line(10)}\nread on" for _ in range(20)), "en", "s") for i in range(8)]  # a label between most lines
    again = [line(20) for _ in range(8)]
    rows += [(2000 + i, f"{again[i]} {line(90)} {again[i]} {line(90)}", "en", "s") for i in range(8)]  # 18 % of the words, no line twice
    got = {r.doc_id: r for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values()) and all(got[i].kept for i in range(300))
    assert all(got[1000 + i].n_dup_lines == 19 and got[1000 + i].n_repeat_words == 0 and not got[1000 + i].kept for i in range(8))
    assert all(got[2000 + i].n_dup_lines == 0 and got[2000 + i].n_repeat_words == 40 and not got[2000 + i].kept for i in range(8))


def fitted(x):
    """Mean, Cholesky factor and scale of a group's rows, by the rule in the module's docstring."""
    floor = np.diag(np.square(q._FLOOR))
    quantile = lambda v, p: sorted(v)[max(math.ceil(p * len(v)), 1) - 1]
    estimate = lambda y: (y.mean(axis=0), np.linalg.cholesky(np.cov(y.T, bias=True) + floor))
    d2 = lambda e: np.square(np.linalg.solve(e[1], (x - e[0]).T)).sum(axis=0)
    step = lambda e: (lambda d: estimate(x[d <= quantile(d, q.H)]))(d2(e))
    det = lambda e: 2 * np.log(np.diag(e[1])).sum()
    middle = np.array([quantile(c, 0.5) for c in x.T])
    spread = [max((quantile(c, 0.75) - quantile(c, 0.25)) / 1.349, 2 * f) for c, f in zip(x.T, q._FLOOR, strict=True)]
    tried = []
    for e in ((middle, np.diag(spread)), (middle, np.eye(5)), estimate(x)):
        for _ in range(q.TRIAL):
            e = step(e)
        tried.append(e)
    e = min(tried, key=det)
    for _ in range(STEPS - q.TRIAL):
        before, e = e, step(e)
        if abs(det(e) - det(before)) < q.SETTLED:
            break
    return e, max(quantile(d2(e), 0.5) / 4.351, 1.0)


@pytest.mark.parametrize("inline", [q.INLINE, 0])
def test_distances_equal_brute_force(spark, inline):
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    rows = []
    for i in range(260):
        lines = [" ".join(rng.choice(words) + "#" * (rng.random() < 0.05) for _ in range(rng.randrange(4, 30))) for _ in range(rng.randrange(1, 15))]
        lines += [rng.choice(lines)] * (rng.random() < 0.2)
        rows.append((i, "\n".join(lines) + " ###" * (40 if i % 50 == 0 else 0), *rng.choice([("en", "s"), ("en", "s"), ("en", "small"), (None, None)])))
    small = [i for i, r in enumerate(rows) if r[3] == "small"]
    rows = [r for i, r in enumerate(rows) if i not in small[30:]]  # too few for an estimate of their own, and for the pool
    got = {r.doc_id: r for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), inline=inline, steps=STEPS).collect()}
    assert len(got) == len(rows)
    vectors = {}
    for i, text, _, source in rows:
        n, chars, symbols, dup, again, failed = brute(text)
        if not failed:
            vectors.setdefault(source, {})[i] = [math.log(n), 4 * math.log((chars + 1) / n), math.log1p(100 * symbols / n), math.log1p(100 * dup / n), math.log1p(100 * again / n)]
    gone = 0
    for source, x in vectors.items():
        if source == "small":
            assert all(got[i].d2 is None and got[i].kept for i in x)
            continue
        (m, factor), scale = fitted(np.array(list(x.values())))
        for i, v in x.items():
            want = np.square(np.linalg.solve(factor, np.array(v) - m)).sum() / scale
            assert got[i].d2 == pytest.approx(want, rel=1e-6, abs=1e-9)
            assert got[i].kept == (want <= q.LIMIT)
            gone += want > q.LIMIT
    assert 0 < gone < 20


def test_settled_groups_take_no_more_steps(spark, monkeypatch):
    """Groups settle each by itself, and one whose determinant goes up and down by the sketch's rounding of the cut settles too."""
    taken, step = [], q._step

    def counted(rows, groups, h, small):
        out = step(rows, groups, h, small)
        taken.append({r._g for r in out.select("_g").collect()})
        return out

    monkeypatch.setattr(q, "_step", counted)
    swing = iter([0.0, 0.01] * 20)
    estimate = q._estimate
    monkeypatch.setattr(q, "_estimate", lambda rows: estimate(rows).withColumn("det", F.when(F.col("_g") == 3, F.lit(next(swing))).otherwise(F.col("det"))))
    rows = spark.range(2000).select((F.col("id") % 4).alias("_g"), *[F.when(F.col("id") % 4 == 0, F.lit(1.0)).otherwise(F.randn(i) ** (2 * (F.col("id") % 4) + 1)).alias(x) for i, x in enumerate(q.STATS)])
    found = q.estimates(rows).select("_g").collect()
    assert sorted(r._g for r in found) == [0, 1, 2, 3]
    later = taken[q.TRIAL :]
    assert later[0] == {0, 1, 2, 3} and all(b <= a for a, b in zip(later, later[1:])) and len(later) < q.STEPS - q.TRIAL
    assert len(later) > 1 and 0 not in later[1]


def test_empty_table(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_plans_do_not_grow_with_the_groups(spark):
    """A step's plan has one size for 4 and for 500 groups, and one lookup of the estimate."""
    sizes = []
    for n in (4, 500):
        rows = spark.range(60 * n).select((F.col("id") % n).alias("_g"), *[F.rand(i).alias(x) for i, x in enumerate(q.STATS)])
        groups = q.keep(q._estimate(rows), "mcd")
        plan = q._measured(rows, groups, how="inner").where("d2 < 9")._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
        assert plan.count("Join") == 1
    assert max(sizes) < 40_000 and abs(sizes[0] - sizes[1]) < 500


def test_names_of_working_columns_pass_through_or_give_way(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 101}" for j in range(40 + i)), "en", "s", "mine", 7, "s") for i in range(80)]
    got = q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, z0 string, z3 int, _s string"), steps=3)
    assert "_s" not in got.columns and {(r.z0, r.z3) for r in got.collect()} == {("mine", 7)}


def test_registered_query_against_sql_and_brute_force(spark, sf_dir):
    """Counts against DuckDB on the whole table, and words by window against brute force."""
    sql = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d), k AS (SELECT doc_id, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))
    SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
      len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n, 0) AS n_dup_lines
    FROM d LEFT JOIN (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k GROUP BY doc_id) USING (doc_id)"""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {r[0]: r for r in con.execute(sql).fetchall()}
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    got = op9_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[r.doc_id]
        assert (r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])[4:] and r.kept == (not r.base_failed and (r.d2 is None or r.d2 <= q.LIMIT))
    assert 0 < sum(r.base_failed for r in got) < sum(r.kept for r in got)
