"""Best-fit packing of documents into sequences of a fixed length.

Hierarchical residual packing. Each task packs its pieces best-fit, longest
first, and passes on only the bins that are not nearly full. Those bins are
items of the next round, in fewer tasks, where bins of different tasks meet;
and so on up the tree. A round's tasks get about ``target`` bins each, dealt in turn,
so the last ones stay small however large the input. After a round, bins with less
room than the least filled bin left are done as well, since nothing can join them. Rounds
end when one task has seen all that is left, or when ``STALE`` rounds in a row,
each with other bins together, have merged less than a tenth. A bin holds at
most ``capacity`` pieces, as each has a token.

A document that fits is one piece. A longer one is cut from its end into full
pieces, so that only the first can be shorter. Null texts are empty and still
have their end token. Repeated rows are packed each by itself; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import keep
from tidemill.llm.tokens import TOKENIZER, encoder

CAPACITY = 1024
END = 2
NEARLY_FULL = 0.99
TARGET = 16_000
STALE = 3

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_MEMBER = pa.struct([*_PIECE, ("offset", pa.int64())])
_BIN = pa.schema([("fill", pa.int64()), ("done", pa.bool_()), ("members", pa.list_(_MEMBER))])
_BIN_DDL = "fill long, done boolean, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of each document, with a checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], dtype="<u4").tobytes()
                out += [(doc_id, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=pa.schema(list(_PIECE)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` by bin: longest first, each into the fullest bin that has room.

    Bins are kept by the room they have left, and the rooms in use as bits of
    one number, so finding the tightest room is a shift and a lowest bit.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        n = sizes[i]
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            by_room[left].append(k)
            rooms |= 1 << left
    return bins


def _placed(members: pa.StructArray, ends: np.ndarray) -> pa.StructArray:
    """Members of bins, end to end, with their offsets in their bins; ``ends`` are the bins' borders among them."""
    before = np.cumsum([0, *members.field("length").to_numpy()])
    offset = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
    return pa.StructArray.from_arrays([*(members.field(f.name) for f in _PIECE), pa.array(offset, pa.int64())], fields=list(_MEMBER))


def _round(bins: DataFrame, capacity: int, nearly_full: float, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        fill = [n for b in got for n in b.column("fill").to_pylist()]
        members = pa.concat_arrays([pa.array([], _BIN.field("members").type), *(b.column("members").cast(_BIN.field("members").type) for b in got)])
        packed = best_fit(fill, capacity)
        for at in range(0, len(packed), 4096):
            part = packed[at : at + 4096]
            order = pa.array([i for p in part for i in p], pa.int64())
            taken = members.take(order)
            offsets = np.cumsum([0, *taken.value_lengths().to_pylist()])[np.cumsum([0, *map(len, part)])]
            full = np.array([sum(fill[i] for i in p) for p in part], dtype="int64")
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _placed(taken.flatten(), offsets))
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array((full >= nearly_full * capacity) | last), lists], schema=_BIN)

    return bins.mapInArrow(run, _BIN_DDL)


def pack(parts: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, target: int = TARGET) -> DataFrame:
    """Pieces dealt to sequences: ``sequence_id`` and the ``offset`` in it beside the pieces' columns."""
    parts = keep(parts, "pieces")
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    alone = parts.where(F.col("length") == capacity).select(F.array(item).alias("members"))
    left = parts.where(F.col("length") < capacity).select(F.col("length").alias("fill"), F.lit(False).alias("done"), F.array(item).alias("members"))
    finished, n, stale = [alone], left.count(), 0
    while n:
        tasks = -(-n // target)
        last = tasks == 1 or stale == STALE
        done = keep(_round(left.repartition(tasks), capacity, nearly_full, last), "bins")
        finished.append(done.where("done").select("members"))
        left = done.where("NOT done")
        least = left.agg(F.min("fill")).first()[0]
        if least is None:
            break
        closed = F.col("fill") + least > capacity
        finished.append(left.where(closed).select("members"))
        left = left.where(~closed)
        before, n = n, left.count()
        stale = stale + 1 if n > 0.9 * before else 0
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    numbered = out.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
