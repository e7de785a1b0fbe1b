"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes; two
documents link when ``100 * |A & B| >= 80 * |A | B|``. Documents with equal sets
form a class and are handled once, so copies are never paired.

*Prefixes.* One order of all shingles holds for every document: by hash, and
after those the frequent shingles by frequency. Similar sets of ``n`` shingles
share at least ``need = ceil(0.8 n)``, so they share ``k`` or more among their
first ``n - need + k``. Each document takes its own ``k``: it estimates, from the
frequencies, what candidates a longer prefix costs and how many of them the
further matches rule out before verification, and takes the cheapest. A pair must share
the smaller ``k`` of the two.

*Front and back.* If the ``j``-th shingle that two sets share stands at places ``p``
and ``q`` in them, they share at most ``j - 1 + min(n - p, m - q)``. A linked pair
needs four ninths of ``n + m``, so each of its first ``k`` common shingles is, in one set at
least, among the first ``n - ceil(8 n / 9) + k``. That much of a prefix is its front, and
so are all its shingles that aren't hot. Lists of documents by shingle are paired front
with front and front with back, never back with back. A long list of texts built on one
template, each with enough text of its own not to link, holds the template's
shingles in their backs alone and gives no pair at all; and of the other documents in
a hot shingle's list those go that are too large or too small for all its fronts.
Shingles that aren't hot are always counted, so what a pair shares must reach the
overlap it needs even if it shared all its others. All of this is certain for
linked pairs, so nothing is lost. Which shingles count as frequent or hot only
moves cost: the table of them has at most ``FREQUENT`` rows.

*Links.* Each class is first compared with one hub: of the classes that share one
of its least shingle hashes, one met most often and of the most usual shingles.
That joins large groups of near copies by a number of pairs linear in their size.
Then every other pair that shares prefix shingles and is not yet in one
component is counted, and those with enough matches are compared on whole
sets. All links left out are between classes that already reach each other, so
components are exact.

Classes are named by a 64-bit hash of their set. A second one tells apart sets that
share the first, should that ever happen, so classes rest on 128 bits.

Null and empty texts have no shingle and link with nothing. Texts of fewer than
five words have their whole sequence as one shingle. Rows without an id get
no component. Repeated rows are copies. Other columns are ignored, but for those
asked for by ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import forget, keep
from tidemill.llm.components import components

WIDTH = 5
PERCENT = 80
FREQUENT = 500_000
OFTEN = 4
#: A shingle of at least so many documents is hot. Cost of comparing a pair's whole sets, in pairs of a list.
HOT = 32
VERIFY = 32
HELD = 2_000_000
FIRST = 6
#: The filter of ids has 16 bits for each, within these bounds.
BLOOM_LEAST, BLOOM_MOST = 1 << 16, 1 << 28

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = np.ones((2, 1), dtype=np.uint64)


def _grown(n: int) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        with np.errstate(over="ignore"):
            _powers = np.stack([np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(2 * n, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)])
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(width, len(words))
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    power, inverse = _grown(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        a, b = begins[: len(words) - size + 1], ends[size - 1 :]
        h = (sums[b] - sums[a]) * inverse[a] + mixed((b - a).astype(np.uint64))
    return np.unique(mixed(h))


def class_id(s: np.ndarray, seed: int = 1) -> int:
    """A hash of a set of shingles."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(s + np.uint64(seed)).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def needed(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


@dataclass
class Prefix:
    """A set's first shingles in the common order, how many of them are its front and how many aren't hot, the matches it asks for, and the mean frequency of all its shingles."""

    tokens: np.ndarray
    front: int
    cold: int
    k: int
    usual: float


def prefix(s: np.ndarray, tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT, hot: int = HOT) -> Prefix:
    """``tokens``: the frequent shingles, sorted, with their ``counts``."""
    n, need = len(s), needed(len(s), percent)
    both = -(-2 * percent * n // (100 + percent))
    freq = np.zeros(n, dtype=np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        freq = np.where(tokens[at] == s, counts[at], 0)
        if freq.any():
            order = np.argsort(freq, kind="stable")
            s, freq = s[order], freq[order]
    cold = int(np.searchsorted(freq, hot))
    front = lambda k: max(n - both + k, min(n - need + k, cold))
    k = min(2, need)
    if freq[:front(k)].any():
        # Documents met in the lists of the front, and what is left to compare of them when k must be shared.
        met = np.cumsum(freq)
        tried = sorted({min(need, both, int(x)) for x in (2, 3, 4, 6, 8, 12, 16, 24, 32, *(need * f / 8 for f in range(1, 5)))} - {0})
        k = min(tried, key=lambda k: (int(met[min(front(k), n) - 1]) * (1 + VERIFY / k), k))
    return Prefix(s[: n - need + k], front(k), min(cold, n - need + k), k, float(freq.sum() / n) if n else 0.0)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate([np.zeros(0, dtype=np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(values))


def _sets(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Small batches with the sets of their texts, the second column."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            part = b.slice(at, size)
            yield part, [shingles(t.as_py()) for t in part.column(1)]


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are often in documents, and about how often: each task counts all of its own and passes on those it has met twice."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeats(sets: list[np.ndarray]) -> pa.RecordBatch:
            t, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(t[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["token", "n"])

        held: list[np.ndarray] = []
        size = 0
        for _, sets in _sets(batches):
            held += sets
            size += sum(map(len, sets))
            if size >= HELD:
                yield repeats(held)
                held, size = [], 0
        yield repeats(held)

    found = keep(docs.mapInArrow(local, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN), "frequent")
    # Of shingles with at least this share of the total there can't be more than FREQUENT.
    total = found.agg(F.sum("n")).first()[0] or 0
    got = found.where(F.col("n") >= max(OFTEN, total / FREQUENT)).toArrow()
    forget(found)
    tokens, counts = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _bloom(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of ids and its bits, put together on the executors; it saves work and decides nothing."""
    size = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (16 * ids.count()).bit_length()))
    bits = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), "rep"), F.lit(size)) for k in range(2)])).alias("bit"))
    words = bits.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("v")).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("v").to_numpy()
    return out, size


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` ``x, y`` of classes, each once, that link by their whole sets."""
    pairs = keep(pairs, "pairs")
    ids = keep(pairs.select(F.explode(F.array("x", "y")).alias("cid")).distinct().join(classes, "cid").select("cid", "rep"), "needed")
    bloom, size = _bloom(ids)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            hit = np.ones(b.num_rows, dtype=bool)
            for k in (2, 3):
                at = b.column(k).to_numpy()
                hit &= (bits[at // 64] >> (at % 64)) & 1 == 1
            few = b.filter(pa.array(hit))
            for part, found in _sets([few]):
                cid = pa.array([class_id(s) for s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([cid, part.column(0), _lists(found)], ["cid", "rep", "s"])

    here = [F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(size)).alias(f"h{k}") for k in range(2)]
    sets = docs.where("doc_id IS NOT NULL").select("doc_id", "text", *here).mapInArrow(passes, "cid long, rep long, s array<long>")
    # A row for each class: repeated rows have the same id and set.
    sets = keep(sets.join(ids, ["cid", "rep"], "left_semi").groupBy("cid", "rep").agg(F.first("s").alias("s")).select("cid", "s"), "sets")
    x, y = (sets.select(F.col("cid").alias(c), F.col("s").alias(f"s{c}")) for c in "xy")
    # Nothing stands above these joins that needs a hub's rows together, so adaptive execution may split them.
    both, total = F.size(F.array_intersect("sx", "sy")), F.size("sx") + F.size("sy")
    found = pairs.join(x, "x").join(y, "y").where(both * (100 + percent) >= total * percent).select("x", "y")
    found = keep(found, "links")
    forget(sets, ids, pairs)
    shared.destroy()
    return found


def _grouped(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entries`` with a name for each class, and the classes; sets with one hash but not the other in common are told apart."""
    usable = entries.where("cid IS NOT NULL AND doc_id IS NOT NULL")
    same = [F.first(c).alias(c) for c in ("n", "k", "cold")]
    classes = keep(usable.groupBy("cid").agg(F.min("doc_id").alias("rep"), *same, F.min("check").alias("a"), F.max("check").alias("b")), "classes")
    if not classes.where("a <> b").limit(1).count():
        return entries, classes
    clash = classes.where("a <> b").select("cid", F.lit(True).alias("again"))
    renamed = F.when(F.col("again"), F.xxhash64("cid", "check")).otherwise(F.col("cid"))
    return _grouped(entries.join(clash, "cid", "left").withColumn("cid", renamed).drop("again"))


def _classes(docs: DataFrame, carry: list[str], percent: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's class; the classes with their least ids; and the prefix of each class, from a row that has that id."""
    tokens, counts = _frequent(docs)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, counts))
    own = ["cid", "check", "n", "k", "front", "cold", "usual", "first", "tokens"]

    def entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches):
            found = [prefix(s, *shared.value, percent, hot) for s in sets]
            yield pa.RecordBatch.from_arrays([
                part.column(0), *part.columns[2:], *(pa.array([class_id(s, seed) if len(s) else None for s in sets], pa.int64()) for seed in (1, 2)), pa.array(list(map(len, sets)), pa.int64()),
                pa.array([p.k for p in found], pa.int64()), pa.array([p.front for p in found], pa.int64()), pa.array([p.cold for p in found], pa.int64()), pa.array([p.usual for p in found], pa.float64()), _lists([s[:FIRST] for s in sets]), _lists([p.tokens for p in found]),
            ], ["doc_id", *carry, *own])

    schema = docs.drop("text").schema
    for c in own:
        schema = schema.add(c, T.DoubleType() if c == "usual" else T.ArrayType(T.LongType()) if c in ("first", "tokens") else T.LongType())
    whole = keep(docs.mapInArrow(entry, schema), "entries")
    entries, classes = _grouped(whole)
    usable = entries.where("cid IS NOT NULL AND doc_id IS NOT NULL")
    one = keep(usable.join(classes.select("cid", F.col("rep").alias("doc_id")), ["cid", "doc_id"], "left_semi").select("cid", "n", "front", "usual", "first", "tokens"), "prefixes")
    rows = keep(entries.select("doc_id", *carry, "cid", "n"), "rows")
    forget(whole)
    shared.destroy()
    return rows, classes, one


def _near(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _hub_pairs(one: DataFrame, percent: int) -> DataFrame:
    """Each class with its hub."""
    first = keep(one.select(F.explode("first").alias("token"), "cid", "n", "usual").distinct(), "first")
    hubs = first.groupBy("token").agg(F.max(F.struct("usual", "cid", "n")).alias("h"), F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b")
    hubs = hubs.select("token", F.col("h.usual").alias("hub_usual"), F.col("h.cid").alias("hub"), F.col("h.n").alias("hub_n"))
    met = first.join(hubs, "token").where((F.col("cid") != F.col("hub")) & _near("n", "hub_n", percent)).groupBy("cid", "hub").agg(F.struct(F.count("*").alias("m"), F.max("hub_usual"), "hub").alias("b"))
    pairs = keep(met.groupBy("cid").agg(F.max("b").alias("b")).select(F.col("cid").alias("x"), F.col("b.hub").alias("y")), "hubs")
    forget(first)
    return pairs


def _candidates(posted: DataFrame, classes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components in ``known`` that share enough of their prefixes.

    ``posted``: ``token, cid, at``, the place of a shingle in its class's prefix; places
    behind the front are negative, less one.
    """
    at = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
    each = posted.join(classes.select("cid", "n", "k", "cold"), "cid").join(known, F.col("cid") == F.col("node"), "left")
    # The overlap that is still possible if this is one of the first k matches, and the largest partner that allows.
    most = F.least(F.col("n"), F.col("n") - at + F.col("k") - 1)
    each = each.select("token", "cid", "n", "k", "cold", (F.col("at") >= 0).alias("ahead"), (at >= F.col("cold")).alias("hot"), F.coalesce("comp", "cid").alias("comp"), most.alias("most"))
    each = keep(each.withColumn("reach", F.expr(f"most * {100 + percent} div {percent} - n")), "posted")
    ahead = F.when(F.col("ahead"), F.col("n"))
    lists = each.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min(ahead).alias("least_ahead"), F.min("n").alias("least_n"), F.max("reach").alias("most_reach"))
    lists = lists.where("a < b AND least_ahead IS NOT NULL").drop("a", "b")
    # A back needs a front that isn't too large for it; a front needs any partner.
    fits = F.when(F.col("ahead"), (F.col("reach") >= F.col("least_n")) & (F.col("n") <= F.col("most_reach"))).otherwise(F.col("reach") >= F.col("least_ahead"))
    sides = ("cid", "comp", "n", "k", "cold", "hot", "ahead", "most")
    rest = keep(each.join(lists, "token").where(~F.col("hot") | fits).select("token", *sides), "lists")
    forget(each)
    x, y = (rest.select("token", *[F.col(c).alias(f"{c}_{side}") for c in sides]) for side in "xy")
    total = F.col("n_x") + F.col("n_y")
    fit = ~F.col("hot_x") | (F.least("most_x", "most_y") * (100 + percent) >= total * percent)
    # Of two fronts the pair is named once; of a front and a back the front is x.
    once = ~F.col("ahead_y") | (F.col("cid_x") < F.col("cid_y"))
    pairs = x.where("ahead_x").join(y, "token").where(once & (F.col("comp_x") != F.col("comp_y")) & _near("n_x", "n_y", percent) & fit)
    behind = F.greatest(F.col("n_x") - F.col("cold_x"), F.col("n_y") - F.col("cold_y"))
    least = F.greatest(F.least("k_x", "k_y"), F.ceil(total * percent / (100 + percent)) - behind)
    pairs = pairs.select(F.least("cid_x", "cid_y").alias("x"), F.greatest("cid_x", "cid_y").alias("y"), least.alias("least"))
    pairs = pairs.groupBy("x", "y").agg(F.count("*").alias("m"), F.first("least").alias("least"))
    found = keep(pairs.where("m >= least").select("x", "y"), "candidates")
    forget(rest)
    return found


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of each row, what ``carry`` names, and ``component``, a key that differs between components even if ids repeat."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    rows, classes, one = _classes(docs, list(carry), percent, hot)
    places = one.select(F.posexplode("tokens").alias("at", "token"), "cid", "front").select("token", "cid", F.when(F.col("at") < F.col("front"), F.col("at")).otherwise(-1 - F.col("at")).alias("at")).repartition("token")
    several = places.groupBy("token").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.max("at").alias("at")).where("a < b AND at >= 0").select("token")
    posted = keep(places.join(several, "token", "left_semi").distinct(), "places")
    hubs = _hub_pairs(one, percent)
    forget(one)
    links = _linked(docs.select("doc_id", "text"), classes, hubs, percent)
    forget(hubs)
    known = components(links)
    candidates = _candidates(posted, classes, known.select("node", "comp"), percent)
    forget(posted, known)
    more = _linked(docs.select("doc_id", "text"), classes, candidates, percent)
    forget(candidates)

    comp = components(links.unionByName(more))
    forget(links, more)
    comp = classes.join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = comp.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = comp.join(least, "comp").select("cid", F.col("rep").alias("class_id"), "component_id", "comp")
    out = rows.withColumnRenamed("n", "n_shingles").join(named, "cid", "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    return out.select("doc_id", *carry, "n_shingles", own("class_id"), own("component_id"), F.col("comp").alias("component"))
