import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import packing, token_counts
from tidemill.llm.registry import op6_token_counts, op8_best_fit_packing
from tidemill.llm.tokens import encoder

TEXTS = [None, "", " ", "a", "Hello  world\n\n  it's  <|endoftext|> here\t\t x", "é ß   z 漢字", "don't\r\n\r\nstop ", "w " * 3000, "x" * 5000, "same text", "same text"]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_ids_are_those_of_tokenizers(exact):
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab é\n\t  '1_漢\x1c\x85s") for _ in range(rng.randrange(60))) for _ in range(500)]
    assert all(encoder()(t or "") == exact(t) for t in TEXTS + odd)


def test_pack_round_trip(spark, exact):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS offset", "3 AS fill")
    out = packing.pack(packing.pieces(df)).collect()
    by_doc = {}
    for r in sorted(out, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = [*exact(t), 2]
        got = by_doc[i][:1] if i == 3 else by_doc[i]
        assert [r.piece for r in got] == list(range(len(got)))
        assert sum(r.length for r in got) == len(ids) and all(r.length == 1024 for r in got[1:])
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in out) // 1024) + 1


def test_rounds_meet_residuals_of_other_tasks(spark):
    rng = random.Random(2)
    sizes = [rng.choice([300, 500, 724, 524, 10, 1014]) for _ in range(3000)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(df, target=200).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024
    assert len(fill) <= len(packing.best_fit(sizes, 1024)) * 1.03


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 10) == []
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_length_histogram(spark, exact):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").selectExpr("*", "1 AS n_tokens")
    got = {r.n_tokens: r for r in token_counts.suffix_sums(token_counts.length_histogram(df), block=7).collect()}
    lengths = [len(exact(t)) for t in TEXTS]
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert (r.n_docs, r.docs_from, r.docs_cut) == (lengths.count(n), sum(x >= n for x in lengths), sum(x > n for x in lengths))
        assert (r.tokens_from, r.truncated_total) == (sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
        assert r.tokens_total == sum(lengths) and r.quantile == sum(x <= n for x in lengths) / len(lengths)
    sums = token_counts.suffix_sums(token_counts.length_histogram(df))
    assert [tuple(r) for r in token_counts.truncated_totals(sums, [0, 4, 100_000]).collect()] == [(c, sum(min(x, c) for x in lengths), sum(x > c for x in lengths)) for c in (0, 4, 100_000)]
    assert [r.n_tokens for r in token_counts.length_quantiles(sums, [0.0, 0.5, 1.0]).collect()] == [min(lengths), sorted(lengths)[-(-len(lengths) // 2) - 1], max(lengths)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(df)).count() == 0
    sums = token_counts.suffix_sums(token_counts.length_histogram(df))
    assert sums.count() == 0
    assert [tuple(r) for r in token_counts.truncated_totals(sums, [5]).collect()] == [(5, 0, 0)]


def test_queries_on_a_table(spark, sf_dir, exact):
    ids = {r.doc_id: exact(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lengths = np.array([len(x) for x in ids.values()])
    got = {r.n_tokens: r for r in op6_token_counts(spark, sf_dir).collect()}
    assert set(got) == set(lengths.tolist())
    for n, r in got.items():
        assert (r.n_docs, r.docs_from, r.tokens_from, r.truncated_total) == ((lengths == n).sum(), (lengths >= n).sum(), lengths[lengths >= n].sum(), np.minimum(lengths, n).sum())
    out = op8_best_fit_packing(spark, sf_dir).collect()
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole = np.array([*ids[r.doc_id], 2], "<u4")
        assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
    for i, x in ids.items():
        assert [(pieces[i][k].start, pieces[i][k].length) for k in range(len(pieces[i]))] == packing.cut(len(x) + 1, 1024)
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(sequences) <= 1.01 * (lengths.sum() + len(lengths)) / 1024 + 1


def test_one_row_repeated_is_dealt_to_all_tasks(spark):
    df = spark.range(30_000).selectExpr("cast(null as long) AS doc_id", "0 AS piece", "0L AS start", "340L AS length", "7L AS ids_crc32")
    out = packing.pack(df, target=1000)
    fill = out.groupBy("sequence_id").count().groupBy("count").count().collect()
    assert {r[0]: r[1] for r in fill} == {3: 10_000}
    placed = out.groupBy("sequence_id").agg(F.array_sort(F.collect_list("offset")).alias("offsets")).select("offsets").distinct().collect()
    assert [r.offsets for r in placed] == [[0, 340, 680]]
