"""Language identification, word first with character n-grams behind.

Words are runs of letters (``\\p{L}``) of the text in lower case, cut by the same
expression for training and prediction. Training counts every word of the
labelled rows by language, and from those counts every character n-gram of
``^word$`` up to four characters. A known word votes with its log frequency in each
language, normalised over the languages. An unseen word votes with the mean over
its places of the longest n-gram known there, so it falls back from four
characters to one; a place without any counts for nothing. A text's votes are
summed; the score is the winner's share after a soft maximum. Votes are whole
multiples of ``1 / SCALE``, so sums don't depend on their order.

No word and no n-gram is cut. The most frequent words, at most ``max_words``, are
looked up in the tasks that read the texts; that number only says where. The other
words of a text leave it with their number and are joined, as distinct words,
with the whole table of words; those it hasn't are cut into n-grams and joined with the
table of n-grams, of which nothing goes to the driver.

Null texts and texts without a letter get ``und`` and score 0, and so does
everything if there is no labelled row. Labels that are null are not learned.
Ties go to the first language in alphabetical order. Texts are read whole. Repeated
rows are predicted each alike. Other columns pass through, but for those named
like the results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import forget, fresh, keep, let

MAX_WORDS = 200_000
LONGEST = 4
SCALE = 1 << 16
UNKNOWN = "und"
ROWS = 500


@dataclass
class Model:
    """The languages, the most frequent words with their votes, and tables ``word, votes`` and ``gram, votes`` of all others."""

    languages: list[str]
    words: list[str]
    word_votes: np.ndarray
    rest: DataFrame | None = None
    grams: DataFrame | None = None


def cleaned(text: Column | str) -> Column:
    """The words of a text with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def _votes(counts: DataFrame, key: str, languages: list[str], totals: list[int]) -> DataFrame:
    """``key, n, votes``: log frequency by language less the log of their sum; a pseudo-count scaled to each language's size keeps it finite."""
    each = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(languages)]
    p = F.array(*[(F.col(f"n{i}") + 0.05 * x / max(totals)) / float(x) for i, x in enumerate(totals)])
    votes = let(p, lambda a: let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), lambda s: F.transform(a, lambda x: F.round(F.log(x / s) * SCALE).cast("int"))))
    return counts.groupBy(key).agg(F.sum("n").alias("n"), *each).select(key, "n", votes.alias("votes"))


def _cut(word: str, k: int) -> Column:
    """The ``k`` characters from each place of ``^word$`` on; near its end, what is left."""
    w = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 2), lambda i: F.substr(w, i, F.lit(k)))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS) -> Model:
    words = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(F.split(cleaned(text_col), " ")).alias("word"))
    counts = keep(words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    size = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(size)
    if not languages:
        return Model([], [], np.zeros((0, 0), "int64"))
    totals = [size[x] for x in languages]
    # Classes of frequency, a quarter of a power of two each: as many of the highest as have max_words words together.
    table = keep(_votes(counts, "word", languages, totals).withColumn("often", F.floor(F.log2("n") * 4).cast("int")), "votes")
    held, least = 0, None
    for r in sorted(table.groupBy("often").agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r.n
        if held > max_words:
            break
        least = r.often
    top = table.where(F.col("often") >= least if least is not None else F.lit(False)).select("word", "votes").toArrow()
    rest = table.where(F.col("often") < least if least is not None else F.lit(True)).select("word", "votes")
    exact = lambda k: F.filter(_cut("word", k), lambda g: F.length(g) == k)
    cuts = F.flatten(F.array(*map(exact, range(1, LONGEST + 1))))
    grams = counts.select("lang", "n", F.explode(cuts).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = keep(_votes(grams, "gram", languages, totals).select("gram", "votes"), "grams")
    votes = np.array(top.column("votes").to_pylist(), "int64").reshape(-1, len(languages))
    return Model(languages, top.column("word").to_pylist(), votes, rest, grams)


def _parts(texts: DataFrame, model: Model) -> DataFrame:
    """A kept table: beside the columns of ``texts``, less the text, the last one: whether it has a word, the votes of its words in the model, and its other words with their numbers."""
    shared = texts.sparkSession.sparkContext.broadcast((model.words, model.word_votes))
    kept = texts.columns[:-1]
    other = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, votes = shared.value
        index = {w: i for i, w in enumerate(words)}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                some, sums, left, left_n, ends = [], [], [], [], [0]
                for t in part.column(len(kept)):
                    n = Counter(t.as_py().split())
                    ids = np.fromiter((index.get(w, -1) for w in n), "int64", len(n))
                    times = np.fromiter(n.values(), "int64", len(n))
                    known = ids >= 0
                    some.append(bool(n))
                    sums.append(times[known] @ votes[ids[known]])
                    if not known.all():
                        left += [w for w in n if w not in index]
                        left_n.append(times[~known])
                    ends.append(len(left))
                struct = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(np.concatenate([np.zeros(0, "int64"), *left_n]))], fields=list(other))
                each = [pa.array(some, pa.bool_()), pa.array(sums, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *each], [*kept, "some", "sums", "other"])

    out = keep(texts.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in texts.dtypes[:-1])}, some boolean, sums array<long>, other array<struct<word: string, n: long>>"), "parts")
    shared.destroy()
    return out


def _unseen(words: DataFrame, grams: DataFrame, languages: int) -> DataFrame:
    """``word, votes`` of words from their n-grams.

    What a place falls back to depends on the four characters there alone, so
    these are settled first, each once.
    """
    places = words.select("word", F.explode(_cut("word", LONGEST)).alias("asked"))
    found = places.select("asked").distinct()
    for k in range(LONGEST, 0, -1):
        known = grams.where(F.length("gram") == k).select(F.col("gram").alias(f"g{k}"), F.col("votes").alias(f"v{k}"))
        found = found.join(known, F.substring("asked", 1, k) == F.col(f"g{k}"), "left").drop(f"g{k}")
    found = found.select("asked", F.coalesce(*[f"v{k}" for k in range(LONGEST, 0, -1)]).alias("v"))
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(languages)]
    total = places.join(keep(found.where("v IS NOT NULL"), "places"), "asked").groupBy("word").agg(F.count("*").alias("k"), *sums)
    return total.select("word", F.array(*[F.round(F.col(f"s{i}") / F.col("k")).cast("int") for i in range(languages)]).alias("votes"))


def text_key(text_col: str = "text") -> dict[str, Column]:
    """What a text is known by: its hash and its length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"text_hash": F.xxhash64(text), "text_size": F.length(text)}


def judged(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """A kept table with a row for each distinct text: its key, ``lang_pred`` and ``score``."""
    key = text_key(text_col)
    names = list(key)
    if not model.languages:
        return keep(docs.select(*[e.alias(c) for c, e in key.items()]).distinct().select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")), "judged")
    text = cleaned(F.coalesce(F.col(text_col), F.lit("")))
    parts = _parts(docs.select(F.monotonically_increasing_id().alias("row"), *[e.alias(c) for c, e in key.items()], text.alias("text")), model)
    other = parts.select("row", F.inline("other"))
    asked = keep(other.select("word").distinct().join(model.rest, "word", "left"), "asked")
    langs = range(len(model.languages))
    unseen = _unseen(asked.where("votes IS NULL").select("word"), model.grams, len(model.languages))
    votes = keep(asked.where("votes IS NOT NULL").unionByName(unseen), "votes")
    added = other.join(votes, "word").groupBy("row").agg(*[F.sum(F.col("n") * F.col("votes")[i]).alias(f"a{i}") for i in langs])
    total = F.array(*[F.col("sums")[i] + F.coalesce(F.col(f"a{i}"), F.lit(0).cast("long")) for i in langs])
    most = F.array_max("total")
    best = F.get(F.array(*[F.lit(x) for x in model.languages]), (F.array_position("total", most) - 1).cast("int"))
    share = 1 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp((x - most) / SCALE))
    found = parts.select("row", *names, "some", "sums").join(added, "row", "left").select(*names, "some", total.alias("total"))
    found = found.select(*names, F.when(F.col("some"), best).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("some"), share).otherwise(0.0).alias("score"))
    out = keep(found.dropDuplicates(names), "judged")
    forget(asked, votes, parts)
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; only the text is read."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())])
    key = text_key(text_col)
    names = {c: fresh(docs, c) for c in key}
    found = judged(docs, model, text_col).withColumnsRenamed(names | {"lang_pred": pred, "score": score})
    return docs.withColumns({names[c]: e for c, e in key.items()}).join(found, list(names.values())).select(*docs.columns, pred, score)


def accepted(pred: Column, score: Column, least: float = 0.5) -> Column:
    """Whether a filtering stage keeps a row: it has a language, and more likely than all others together."""
    return (pred != UNKNOWN) & (score >= least)
