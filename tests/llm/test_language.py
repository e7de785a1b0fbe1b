import math
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from tidemill.llm import language
from tidemill.llm.common import documents
from tidemill.llm.registry import op2_language_id

ROWS = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), (None, "en"), ("mystery", None)]
WORD = regex.compile(r"\p{L}+")


def brute(rows, texts):
    """Prediction and score of each text by a model of the rows, all in one process."""
    counts, grams = {}, {}
    for text, lang in rows:
        for w in WORD.findall((text or "").lower()) if lang is not None else ():
            counts.setdefault(w, Counter())[lang] += 1
    for w, n in counts.items():
        for lang, c in n.items():
            for k in range(1, 5):
                for i in range(len(w) + 3 - k):
                    grams.setdefault(f"^{w}$"[i : i + k], Counter())[lang] += c
    total = Counter()
    for n in counts.values():
        total.update(n)
    langs = sorted(total)
    half_up = lambda x: math.copysign(math.floor(abs(x) + 0.5), x)

    def votes(n):
        p = [(n[x] + 0.05 * total[x] / max(total.values())) / total[x] for x in langs]
        return np.array([half_up(math.log(x / sum(p)) * language.SCALE) for x in p])

    def vote(w):
        if w in counts:
            return votes(counts[w])
        marked = f"^{w}$"
        longest = (next((votes(grams[marked[i : i + k]]) for k in (4, 3, 2, 1) if i + k <= len(marked) and marked[i : i + k] in grams), None) for i in range(len(marked)))
        got = [v for v in longest if v is not None]
        return np.array([half_up(x) for x in sum(got) / len(got)]) if got else 0

    known = {}
    out = []
    for text in texts:
        words = WORD.findall((text or "").lower())
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        known.update({w: vote(w) for w in set(words) - set(known)})
        x = sum(known[w] for w in words)
        best = int(np.argmax(x))
        out.append((langs[best], 1 / np.exp((x - x[best]) / language.SCALE).sum()))
    return out


@pytest.mark.parametrize("most", [0, 8, language.MAX_WORDS])
def test_predictions_equal_brute_force(spark, most):
    hot = [(f"alpha beta gamma delta word{chr(97 + i % 26)}", "en") for i in range(60)]
    rows = [*hot, ("alphi beto", "sv"), ("alphi gammo", "sv"), *ROWS]
    texts = [None, "", "12 !?", "½ ² ①", "Ⅷ", "alphi", "alphi alphi beto", "ALPHI beta", "hunde der alphiz", "the cat", "the cat", "alpha 漢字", "漢字", "x", "İstanbul ǅ", "hunde " * 100_000]
    docs = spark.createDataFrame([(i % 3, i, x, 9) for i, x in enumerate(texts)], "doc_id long, word int, text string, score int")
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), max_words=most)
    assert len(model.words) <= most
    out = language.predict(docs, model)
    assert out.columns == ["doc_id", "word", "text", "lang_pred", "score"]
    got = {r.word: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, (lang, score) in enumerate(brute(rows, texts)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-9), texts[i]
    assert [got[i].lang_pred for i in range(5)] == ["und"] * 5


def test_the_query_equals_brute_force_on_a_table(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text", "lang").collect()
    held_out = lambda r: zlib.crc32(str(r.doc_id).encode()) % 3 == 1
    want = brute([(r.text, r.lang) for r in rows if not held_out(r)], [r.text for r in rows])
    got = {r.doc_id: r for r in op2_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    right = 0
    for r, (lang, score) in zip(rows, want, strict=True):
        x = got[r.doc_id]
        assert (x.held_out, x.lang_pred) == (held_out(r), lang) and x.score == pytest.approx(score, abs=1e-6)
        right += held_out(r) and lang == r.lang
    assert right >= 0.99 * sum(map(held_out, rows)) > 100


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    empty = language.train(docs.selectExpr("text", "cast(null as string) AS lang"))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    some = language.train(spark.createDataFrame(ROWS, "text string, lang string"))
    assert language.predict(docs.limit(0), some).count() == 0

