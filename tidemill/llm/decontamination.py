"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with each run of white space as one space. An
item of ``m`` characters may be off by ``k = floor(rate * m)`` edits. Cut into
``k + 1`` pieces, at least one piece of any such occurrence is unchanged, so an
Aho-Corasick automaton over all pieces finds every candidate place in one pass
over a text. There Myers' bit-parallel algorithm gives the least edit distance
of the item to any substring.

The items are a stated query set: they go to the tasks in blocks of at most
``block_chars`` characters, which bounds what is broadcast, and every block is
held against all texts. Null and empty items match nothing, null texts are
empty. Repeated items and repeated documents are reported each. ``start`` and
``end`` are code points of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.08
BLOCK_CHARS = 4_000_000
HIT = "struct<item_id: long, distance: int, budget: int, start: long, end: long>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_BLANK = re.compile(r"\S+")


def fold(text: str | None) -> str:
    """Lower case, character by character where a letter's lower form is longer than itself, and single spaces."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return " ".join(low.split())


def positions(text: str) -> list[int]:
    """The place in ``text`` of each character of ``fold(text)``."""
    out: list[int] = []
    for m in _BLANK.finditer(text):
        out += [m.start() - 1] if out else []
        out += range(m.start(), m.end())
    return out


def cut(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """The budget of an item and its pieces with their places."""
    k = int(rate * len(item))
    ends = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(item: str, text: str, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of ``item`` to a substring of ``text``, and the end of the first such substring."""
    peq = peq or masks(item)
    m = len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = ones, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & ones
        mv = ph & xv
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            if text := fold(raw):
                k, pieces = cut(text, rate)
                for at, piece in pieces:
                    places.setdefault(piece, []).append((len(self.items), at))
                self.items.append((item_id, text, k, masks(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def hits(self, raw: str | None) -> list[dict]:
        """The best occurrence of each item within its budget."""
        text = fold(raw)
        if not text or not self.items:
            return []
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for i, at in where:
                begin, (_, item, k, _) = end + 1 - n - at, self.items[i]
                lo, hi = max(0, begin - k), min(len(text), begin + len(item) + k)
                spans = near.setdefault(i, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        out, place = [], None
        for i, spans in near.items():
            item_id, item, k, peq = self.items[i]
            best = min(((*myers(item, text[lo:hi], peq), lo) for lo, hi in spans), key=lambda x: (x[0], x[1] + x[2]))
            if best[0] <= k:
                d, end, lo = best
                begin = lo + end - myers(item[::-1], text[lo : lo + end][::-1][: len(item) + k])[1]
                place = place or positions(raw)
                out.append({"item_id": item_id, "distance": d, "budget": k, "start": place[begin], "end": place[lo + end - 1] + 1})
        return sorted(out, key=lambda x: (x["start"], x["item_id"]))


def _blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    items = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    n = 1 + int((items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars)
    for k in range(n):
        yield [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()]


def flag(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, name: str = "leaks") -> DataFrame:
    """``docs`` with an array of the items found in each text, empty for a clean one."""
    kept = [c for c in docs.columns if c != name]
    at = kept.index(text_col)
    out = docs.select(*kept).withColumn(name, F.array().cast(f"array<{HIT}>"))
    schema = out.schema
    for block in _blocks(items, item_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                before = b.column(len(kept))
                found = [[*old.as_py(), *matcher.hits(t.as_py())] for old, t in zip(before, b.column(at), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, _HIT)], schema.names)

        out = out.mapInArrow(run, schema)
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item found in it."""
    found = flag(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, rate=rate, block_chars=block_chars)
    return found.select("doc_id", F.inline("leaks")).select("doc_id", "item_id", "distance", "budget", "start", "end")
