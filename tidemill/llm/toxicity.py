"""Toxicity by weak supervision.

*Voters.* Words and word beginnings that labelled toxic texts hold far more
often than labelled clean ones form the lexicon; each that a share of ``COVERAGE`` or more of
the labelled toxic texts holds is a voter that fires on texts with it. A few fixed patterns (shouting, runs of ``!`` or ``?``,
second-person address next to ``are``) vote as well, and so do the numbers of
words from the lexicon: none, two or more, three or more.

*Label model.* A generative model has, for each voter, the chance to fire on
toxic and on clean texts. Expectation maximisation over all training rows,
labelled or not, estimates them and the share of toxic texts; labels give the
starting point and hold their own rows in place. Voters that fire together beyond what the label explains are
correlated; each voter's evidence is divided by one plus the sum of its
correlations, so a word and its beginnings count once. Only pairs of voters that
fire in a same text are ever written down, so there is no table of all pairs; a
text with k voters adds k * (k - 1) / 2 to the sums of its task, which are sent
on when a task holds ``PAIRS`` of them.

*Classifier.* Logistic regression on the lexicon is fitted to the posterior
labels of a sample of at most about ``MAX_ROWS`` training rows. Its output is
the score. Only the text of a row is read to score it.

Texts are read twice: once, the labelled ones, for the lexicon, and once for what
each holds of it. All fitting and scoring works on those lists of numbers. Up to
``FEW`` labels, which are counted, are broadcast to the texts, so that texts stay where
they are; more of them meet the texts in a sort-merge join.

Every token of labelled texts is counted, toxic and clean texts side by side, in
one distributed aggregation. Those in ``least`` toxic texts or more, and in a share of ``SHARE`` or
more of the toxic ones, whose log ratio passes ``LIFT`` are the lexicon, all of
them: nothing is cut by rank. By that share it has at most ``1 / SHARE`` times as
many entries as a toxic text has tokens in the mean, however many texts there are; this is
what bounds the broadcast lexicon, and ``COVERAGE`` bounds the voters in the same way. No number of voters is set. The classifier's rows are
bounded by ``MAX_ROWS``; counts cover all training rows. Null texts are empty and get the
score of a text in which nothing fires. Without both kinds of labels every
score is the labelled share of toxic rows (0 without labels). Labels that are
null, or for unknown ids, are ignored. Repeated rows count each. Columns named like a result, ``_text`` or ``_found`` give way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import forget, keep

#: Tokens that a task counts before it sends what it has.
ROOM = 200_000
FEW = 500_000
MAX_ROWS = 50_000
LEAST = 5
SHARE = 1e-4
COVERAGE = 0.04
#: Pairs of voters whose sums a task holds before it sends them.
PAIRS = 1_000_000
LIFT = 2.0
ROUNDS = 6
BEGINNINGS = range(4, 9)
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = (
    ("shouting", re.compile(r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b", re.S)),
    ("marks", re.compile(r"[!?]{2,}")),
    ("address", re.compile(r"\b(?:you|u)\s+(?:are|r)\b", re.I)),
)


def spelled(w: str) -> list[str]:
    """A word and its beginnings marked with ``*``."""
    return [w, *(f"{w[:k]}*" for k in BEGINNINGS if len(w) > k)]


class Lookup(dict):
    """The numbers of a word's entries in an index, kept for words seen before."""

    ROOM = 300_000

    def __init__(self, index: dict) -> None:
        self.index = index

    def __missing__(self, w: str) -> tuple:
        if len(self) >= self.ROOM:
            self.clear()
        self[w] = found = tuple(self.index[t] for t in spelled(w) if t in self.index)
        return found


@dataclass
class Lexicon:
    """Entries with their numbers, voters before others and the more telling first; how many texts are labelled clean and toxic; how many entries vote."""

    index: dict[str, int]
    labelled: tuple[int, int]
    voters: int


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    @property
    def index(self) -> dict[str, int]:
        return self.lexicon.index


class Spelled(dict):
    """The tokens of a word, kept for words seen before."""

    def __missing__(self, w: str) -> list[str]:
        if len(self) >= ROOM:
            self.clear()
        self[w] = found = spelled(w)
        return found


def _counted(labelled: DataFrame) -> DataFrame:
    """``token, n0, n1``: in how many clean and toxic texts each token is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Spelled(), (Counter(), Counter())

        def sent() -> Iterator[pa.RecordBatch]:
            for y, counts in enumerate(n):
                names, sizes = list(counts), list(counts.values())
                for at in range(0, len(names), 10_000):
                    part = pa.array(sizes[at : at + 10_000], pa.int64())
                    none = pa.array(np.zeros(len(part), dtype="int64"))
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 10_000], pa.string()), none if y else part, part if y else none], ["token", "n0", "n1"])
                counts.clear()

        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                n[y].update({x for w in set(_WORD.findall(t.as_py().lower())) for x in known[w]})
                if len(n[0]) + len(n[1]) >= ROOM:
                    yield from sent()
        yield from sent()

    return labelled.where("y IN (0, 1)").select("text", "y").mapInArrow(run, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def present(text: str | None, lookup: Lookup, voters: int) -> list[int]:
    """Numbers of what is in a text: lexicon entries, the classifier's other features, and how many words vote."""
    entries, words, voting = set(), 0, 0
    for w in set(_WORD.findall((text or "").lower())):
        if found := lookup[w]:
            entries.update(found)
            words += 1
            voting += min(found) < voters
    most = len(lookup.index)
    extra = [not words, words > 1, words > 2, *(p.search(text or "") for _, p in PATTERNS), not voting, voting > 1, voting > 2]
    return sorted(entries) + [most + i for i, x in enumerate(extra) if x]


EXTRA = 3 + len(PATTERNS)


def voices(found: Column, lexicon: Lexicon) -> Column:
    """Of the numbers from ``present``, those of voters: the first entries, how many words vote, and the patterns."""
    most, voters = len(lexicon.index), lexicon.voters
    others = F.filter(found, lambda x: x >= most + 3)
    return F.concat(F.filter(found, lambda x: x < voters), F.transform(others, lambda x: F.when(x < most + EXTRA, x - most).otherwise(x - most - EXTRA) + voters))


class LabelModel:
    """Chances to fire given the label, a prior, and the weight of each voter's evidence."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, prior: float) -> None:
        self.toxic, self.clean, self.prior = (np.clip(x, 1e-6, 1 - 1e-6) for x in (toxic, clean, np.float64(prior)))
        self.weight = np.ones(len(toxic))

    def evidence(self) -> tuple[float, np.ndarray]:
        """Log odds of a text on which nothing fires, and what each firing voter adds."""
        silent = self.weight * np.log((1 - self.toxic) / (1 - self.clean))
        loud = self.weight * np.log(self.toxic / self.clean)
        return float(np.log(self.prior / (1 - self.prior)) + silent.sum()), loud - silent

    def posterior(self, fired: list[list[int]]) -> np.ndarray:
        base, add = self.evidence()
        return 1 / (1 + np.exp(-np.clip([base + add[f].sum() for f in fired], -50, 50)))

    def refit(self, fires: np.ndarray, n: np.ndarray) -> None:
        """Chances and prior from expected counts of each voter's firing and of rows; index 0 is toxic."""
        self.toxic, self.clean = (np.clip((fires[y] + (0.01, 0.001)[y]) / (n[y] + 1), 1e-6, 1 - 1e-6) for y in (0, 1))
        self.prior = np.clip(n[0] / max(n.sum(), 1), 1e-6, 1 - 1e-6)

    def correlated(self, i: np.ndarray, j: np.ndarray, together: np.ndarray, n: float) -> np.ndarray:
        """For each voter the sum of its correlations among ``n`` toxic texts, from expected counts of pairs; each pair once, those that never fire together left out."""
        p = self.toxic
        spread = np.sqrt(p * (1 - p))
        corr = np.clip((together / max(n, 1) - p[i] * p[j]) / np.maximum(spread[i] * spread[j], 1e-9), 0, 1)
        return np.bincount(i, corr, len(p)) + np.bincount(j, corr, len(p))

    def reweigh(self, correlated: np.ndarray) -> None:
        self.weight = 1 / (1 + correlated)


class Pairs:
    """Sums by pair of voters, ``i < j``, of one task, which holds about ``room`` of them at most."""

    def __init__(self, size: int, room: int) -> None:
        self.size, self.room, self.codes, self.sums, self.held = size, room, [], [], 0

    def add(self, fired: np.ndarray, share: float) -> Iterator[pa.RecordBatch]:
        """Takes the pairs of one text, in blocks; yields what is to be sent before there is room for more."""
        step = max(1, self.room // max(len(fired), 1))
        for k in range(0, len(fired) - 1, step):
            i, j = np.repeat(fired[k : k + step], len(fired)), np.tile(fired, len(fired[k : k + step]))
            codes = (i * self.size + j)[i < j]
            self.codes.append(codes)
            self.sums.append(np.full(len(codes), share))
            self.held += len(codes)
            if self.held > 2 * self.room and self.squeeze() > self.room:
                yield from self.sent()

    def squeeze(self) -> int:
        """Adds up equal pairs; how many there are."""
        codes, at = np.unique(np.concatenate([np.zeros(0, "int64"), *self.codes]), return_inverse=True)
        self.codes, self.sums, self.held = [codes], [np.bincount(at, np.concatenate([np.zeros(0), *self.sums]), len(codes))], len(codes)
        return self.held

    def sent(self) -> Iterator[pa.RecordBatch]:
        self.squeeze()
        (codes,), (sums,) = self.codes, self.sums
        for at in range(0, len(codes), 100_000):
            c, x = codes[at : at + 100_000], sums[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c // self.size), pa.array(c % self.size), pa.array(x), pa.array(np.zeros(len(c)))], ["i", "j", "a", "b"])
        self.codes, self.sums, self.held = [], [], 0


def _expected(patterns: DataFrame, model: LabelModel) -> DataFrame:
    """A kept table of expected counts over all rows under the model: ``a`` in toxic texts of each pair ``i < j`` that fires together, ``a`` and ``b`` in toxic and clean texts of each voter ``i = j``, and of rows, ``i = j = -1``."""
    size = len(model.toxic)
    shared = patterns.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, n, pairs = np.zeros((2, size)), np.zeros(2), Pairs(size, PAIRS)
        for b in batches:
            fired, known, count = (b.column(k).to_pylist() for k in range(3))
            fired = [np.array(f, "int64") for f in fired]
            for f, y, c, p in zip(fired, known, count, shared.value.posterior(fired), strict=True):
                share = c * (p if y is None else float(y))
                n += share, c - share
                each[0][f] += share
                each[1][f] += c - share
                if share:
                    yield from pairs.add(f, share)
        yield from pairs.sent()
        at = np.flatnonzero(each.sum(axis=0))
        ids = pa.array(np.append(at, -1))
        yield pa.RecordBatch.from_arrays([ids, ids, pa.array(np.append(each[0][at], n[0])), pa.array(np.append(each[1][at], n[1]))], ["i", "j", "a", "b"])

    return keep(patterns.mapInArrow(run, "i long, j long, a double, b double").groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "expected", sweep=False)


def _refit(patterns: DataFrame, model: LabelModel) -> None:
    """One round: chances from all rows, then weights from all pairs that fire together, whose correlations are summed by task and voter."""
    expected, size = _expected(patterns, model), len(model.toxic)
    fires, n = np.zeros((2, size)), np.zeros(2)
    for r in expected.where("i = j").collect():
        if r.i < 0:
            n[:] = r.a, r.b
        else:
            fires[:, r.i] = r.a, r.b
    model.refit(fires, n)
    shared = expected.sparkSession.sparkContext.broadcast((model, float(n[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (now, toxic), total = shared.value, np.zeros(size)
        for b in batches:
            total += now.correlated(*(b.column(k).to_numpy() for k in range(3)), toxic)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "c"])

    total = np.zeros(size)
    for r in expected.where("i < j").select("i", "j", "a").mapInArrow(run, "i long, c double").groupBy("i").agg(F.sum("c").alias("c")).collect():
        total[r.i] = r.c
    model.reweigh(total)
    forget(expected)


def fit_logistic(rows: list[list[int]], target: np.ndarray, size: int, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on rows of present features, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((j for r in rows for j in r), dtype=np.int64, count=len(at))
    scale = 1 / np.sqrt(1 + np.bincount(col, minlength=size))  # common features take smaller steps
    w, b, n = np.zeros(size), 0.0, max(len(rows), 1)
    v, c, rate = w.copy(), b, 4.0 * np.sqrt(n)
    for k in range(steps):
        x = c + np.bincount(at, weights=v[col], minlength=len(rows))
        e = 1 / (1 + np.exp(-np.clip(x, -50, 50))) - target
        g = np.bincount(col, weights=e[at], minlength=size) / n + ridge * v
        w2, b2 = v - rate * scale * g, c - 2.0 * e.mean()
        m = k / (k + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, float(b)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))


def _marks(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: int = LEAST) -> Lexicon:
    """The lexicon that the labels of training rows give; empty without both kinds of labels."""
    marks = _marks(labels, id_col, label_col)
    marks = F.broadcast(marks) if marks.count() <= FEW else marks.hint("merge")
    labelled = keep(_texts(docs, id_col, text_col).join(marks, "doc_id"), "labelled")
    n = {r.y: r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Lexicon({}, (n0, n1), 0)
    ratio = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    got = _counted(labelled).where((F.col("n1") >= least) & (F.col("n1") >= SHARE * n1)).select("token", "n1", ratio.alias("ratio")).where(F.col("ratio") > LIFT)
    votes = F.col("n1") >= COVERAGE * n1
    ranked = [(r.token, r.votes) for r in got.select("token", votes.alias("votes"), (F.col("ratio") * F.sqrt("n1")).alias("z")).orderBy(F.desc("votes"), F.desc("z"), "token").collect()]
    forget(labelled)
    return Lexicon({w: j for j, (w, _) in enumerate(ranked)}, (n0, n1), sum(v for _, v in ranked))


def find(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with the numbers of what each text holds in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = [c for c in docs.columns if c not in (name, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, voters = Lookup(shared.value.index), shared.value.voters
        for b in batches:
            found = [present(t.as_py(), lookup, voters) for t in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int64()))], [*kept, name])

    return docs.select(*kept, text_col).mapInArrow(run, docs.select(*kept).schema.add(name, T.ArrayType(T.LongType())))


def fit(found: DataFrame, labels: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", label_col: str = "toxic", name: str = "found") -> Model:
    """A model from what training rows hold and the labels of some of them."""
    n0, n1 = lexicon.labelled
    if not n0 or not n1:
        share = n1 / max(n0 + n1, 1)
        return Model(lexicon, np.zeros(EXTRA), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    features, size = len(lexicon.index) + EXTRA, lexicon.voters + EXTRA
    rows = found.select(F.col(id_col).alias("doc_id"), F.filter(name, lambda x: x < features).alias("x"), voices(F.col(name), lexicon).alias("fired"))
    known = _marks(labels, id_col, label_col).where("y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    patterns = keep(rows.select("doc_id", "fired").join(known.hint("merge"), "doc_id", "left").groupBy("fired", "y").agg(F.count("*").alias("n")), "votes")
    fires = np.full((2, size), 0.01)
    for r in patterns.where("y IS NOT NULL").select(F.explode("fired").alias("j"), "y", "n").groupBy("j", "y").agg(F.sum("n").alias("n")).collect():
        fires[r.y, r.j] += r.n
    model = LabelModel(fires[1] / (n1 + 1), fires[0] / (n0 + 1), n1 / (n0 + n1))
    for _ in range(ROUNDS):
        _refit(patterns, model)

    n = patterns.agg(F.sum("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, MAX_ROWS / max(n, 1)))
    got = rows.where(part).select("x", "fired").toArrow()
    return Model(lexicon, *fit_logistic(got.column("x").to_pylist(), model.posterior(got.column("fired").to_pylist()), features))


def rate(found: DataFrame, model: Model, found_col: str = "found", name: str = "score") -> DataFrame:
    """``found`` with the chance of a toxic label in place of what the text holds."""
    shared = found.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kept = [c for c in found.columns if c not in (name, found_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in batches:
            x = np.array([bias + sum(weights[j] for j in f if j < len(weights)) for f in b.column(len(kept)).to_pylist()], dtype="float64")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(x, -50, 50))))], [*kept, name])

    return found.select(*kept, found_col).mapInArrow(run, found.select(*kept).schema.add(name, "double"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: int = LEAST) -> Model:
    """A model from training rows and the labels of some of them."""
    lexicon = learn(docs, labels, id_col, text_col, label_col, least)
    found = keep(find(docs.select(id_col, text_col), lexicon, text_col), "found")
    return fit(found, labels, lexicon, id_col, label_col)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the chance of a toxic label."""
    return rate(find(docs.withColumn("_text", F.col(text_col)), model.lexicon, "_text", "_found"), model, "_found", name)
