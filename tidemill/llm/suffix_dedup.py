"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every byte covered by a string of ``WIDTH`` bytes that also starts elsewhere,
in any document, is removed.

*Which suffixes are sorted.* Each window of ``WIDTH`` bytes has an anchor: the
leftmost of its ``GRAM``-byte strings with the least hash. Equal windows have
the same anchor at the same place, so it is enough to sort the suffixes that
begin at anchors, with the bytes before them that their windows reach; and only
those whose first ``GRAM`` bytes occur at two anchors or more. A filter holds the hashes of
these, 16 bits for each up to ``BLOOM_MOST``; what it lets through besides costs
exchange and decides nothing.

*Order.* Suffixes are ordered by the hash of their first ``GRAM`` bytes, then by
content, then by a tie-break. All that matters stands together as in an order by content
alone, and equal ranges of the hash hold about equally many suffixes, so ranges need no sample and
their number just grows with the input. A gram with more than ``per_range``
suffixes has ranges of its own, to which the tie-break deals them. How many is a power of
two, held by hash in two tables of ``SLOTS_MOST`` bytes at most, which do not grow further: the
lesser of a gram's two slots counts. Grams that share both slots with a larger one get
more ranges than they need, which costs a few small parts and changes no result.

*Sorting.* Each task sorts its suffixes into runs and cuts them at the ranges. The
parts are front-coded (each suffix as the length of the prefix shared with the one
before it, and the rest) and sent to the task of their range. A run is cut into ``FAN`` parts
at most: where there are more ranges, parts go to wider ranges first, are
merged to longer runs there and cut again. At the end a loser tree merges the
runs of a range. A suffix in the tree carries the length of the prefix shared with the last
winner: the longer one wins unseen, and only equal lengths are compared, from there on.

*Matches.* Suffixes with a common gram are neighbours in the merged order. Their
windows are compared, by content or, where many differ, by a 128-bit hash. Of a gram
with several ranges each range names its distinct windows, by hash, and those that
two ranges name repeat.

Null texts are empty. Texts shorter than a window lose nothing. Repeated rows
repeat each other's strings, so they lose all windows. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import forget, keep

WIDTH = 200
GRAM = 64
RUN = 50_000
RANGE = 20_000
FAN = 1 << 9
BLOOM_LEAST, BLOOM_MOST = 1 << 16, 1 << 29
SLOTS_LEAST, SLOTS_MOST = 1 << 12, 1 << 23

_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_CHUNK = 1 << 22
_POSITION = (1 << 23) - 1
_powers = np.ones((2, 1), dtype=np.uint64)


def _grown(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        one = np.ones(1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            _powers = np.stack([np.cumprod(np.concatenate([one, np.full(2 * n, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)])
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and gram hash of each anchor, and the first and last start of the windows that it anchors."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < width:
        return none, none.view(np.uint64), none, none
    found = []
    for at in range(0, len(data) - width + 1, _CHUNK):
        part = np.frombuffer(data[at : at + _CHUNK + width - 1], dtype=np.uint8)
        power, inverse = _grown(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part + np.uint64(1)) * power[: len(part)], out=sums[1:])
            h = _mixed((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
        size = width - gram + 1
        packed = (h & ~np.uint64(_POSITION)) | np.arange(len(h), dtype=np.uint64)
        blocks = np.full(-(-len(h) // size) * size, np.iinfo(np.uint64).max, dtype=np.uint64)
        blocks[: len(h)] = packed
        blocks = blocks.reshape(-1, size)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - size + 1
        place = (np.minimum(after[:n], before[size - 1 : size - 1 + n]) & np.uint64(_POSITION)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [n - 1]])
        p = place[first]
        found.append((p + at, h[p], first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def common(a: bytes, b: bytes, h: int = 0) -> int:
    """Length of the common prefix, of which ``h`` bytes are known."""
    n = min(len(a), len(b))
    while h < n and a[h : h + 32] == b[h : h + 32]:
        h += 32
    if h >= n:
        return n
    while h < n and a[h] == b[h]:
        h += 1
    return h


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Sorted runs of (prefix shared with the one before, suffix, payload) as one such run, by a loser tree.

    All suffixes in the tree are no less than the last winner. Of two, the one
    that shares more with it is less; if both share as much, they are compared
    from there, and the loser keeps what it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple[int, bytes, tuple] | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shared = [0] * k
    losers = [0] * k

    def less(i: int, j: int) -> bool:
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        h = common(a[1], b[1], shared[i])
        if a[1][h:] <= b[1][h:]:
            shared[j] = h
            return True
        shared[i] = h
        return False

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win, losers[node] = (a, b) if less(a, b) else (b, a)
        return win

    win = build(1) if k > 1 else 0
    while (head := heads[win]) is not None:
        yield shared[win], head[1], head[2]
        heads[win] = following = next(runs[win], None) if win < len(runs) else None
        shared[win] = following[0] if following else 0
        node = (win + k) // 2
        while node:
            if not less(win, losers[node]):
                win, losers[node] = losers[node], win
            node //= 2


_HEAD = np.dtype([("shared", "<i4"), ("rest", "<i4"), ("left", "<i4"), ("near", "<i4"), ("did", "<i8"), ("rid", "<i8"), ("at", "<i8")])


def front_coded(entries: list[tuple[bytes, tuple]]) -> tuple[bytes, bytes, bytes]:
    """A sorted run of (suffix, (left bytes, near, did, rid, at)) as heads, rests and left bytes."""
    heads = np.zeros(len(entries), dtype=_HEAD)
    rests, before = [], b""
    for i, (s, (left, near, did, rid, at)) in enumerate(entries):
        h = common(before, s)
        rests.append(s[h:])
        heads[i] = (h, len(s) - h, len(left), near, did, rid, at)
        before = s
    return heads.tobytes(), b"".join(rests), b"".join(e[1][0] for e in entries)


def decoded(heads: bytes, rests: bytes, lefts: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    s, a, b = b"", 0, 0
    for h, rest, left, near, did, rid, at in np.frombuffer(heads, dtype=_HEAD).tolist():
        s = s[:h] + rests[a : a + rest]
        yield h, s, (lefts[b : b + left], near, did, rid, at)
        a, b = a + rest, b + left


def repeated(group: list[tuple[bytes, tuple]], width: int, border: bool = False) -> tuple[list[tuple[int, int, int, int]], list[tuple]]:
    """``did, rid, begin, end`` of what repeats among suffixes with a common gram.

    ``near`` to ``len(left)`` are how far before the suffix its windows start.
    All those that repeat overlap, so the outermost two bound what they cover.
    At a border, there follow the hashes of all windows, each once: with its place
    where it occurs once here, with none where it is settled.
    """
    kinds: dict[tuple[bytes, bytes, int], list[tuple[int, int, int]]] = {}
    for s, (left, near, did, rid, at) in group:
        kinds.setdefault((left, s[:-8], near), []).append((did, rid, at))
    hashed = border or len(kinds) > 100
    seen: dict[bytes, int] = {}

    def windows(left: bytes, s: bytes, near: int) -> Iterator[tuple[int, bytes]]:
        text, far = left + s, len(left)
        for o in range(near, far + 1):
            w = text[far - o : far - o + width]
            yield o, xxhash.xxh3_128_digest(w) if hashed else w

    if border or len(kinds) > 1:
        for kind, where in kinds.items():
            for _, w in windows(*kind):
                seen[w] = seen.get(w, 0) + len(where)
    out, open_ = [], []
    for (left, s, near), where in kinds.items():
        if len(where) > 1:
            hit = (len(left), near)
        elif not seen:
            continue
        else:
            found = []
            for o, w in windows(left, s, near):
                if seen[w] > 1:
                    found.append(o)
                elif border:
                    did, rid, at = where[0]
                    open_.append((did, rid, at - o, at - o + width, w))
            if not found:
                continue
            hit = (found[-1], found[0])
        out += [(did, rid, at - hit[0], at - hit[1] + width) for did, rid, at in where]
    if border:
        open_ += [(None, None, None, None, w) for w, n in seen.items() if n > 1]
    return out, open_


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for did, rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
        yield did, rid, (t.as_py() or "").encode("utf-8", "surrogatepass")


def _suffixes(data: bytes, did: int, rid: int, bits: np.ndarray, width: int, gram: int) -> Iterator[tuple[bytes, tuple]]:
    """The suffixes of a text that may repeat, as sort keys: hash of the gram, content, tie-break."""
    place, h, first, last = anchors(data, width, gram)
    hit = np.ones(len(h), dtype=bool)
    for bit in _bits(h, len(bits) * 64):
        hit &= (bits[(bit // np.uint64(64)).astype(np.int64)] >> (bit % np.uint64(64))) & np.uint64(1) == 1
    order = _mixed(h[hit] + np.uint64(3)).astype(">u8").tobytes()
    for i, (p, a, b) in enumerate(zip(place[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True)):
        tie = struct.pack(">Q", xxhash.xxh64_intdigest(struct.pack("<qqq", did, rid, p)))
        yield order[8 * i : 8 * i + 8] + data[p : min(p + width, b + width)] + tie, (data[a:p], p - b, did, rid, p)


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    return [_mixed(h + np.uint64(k)) % np.uint64(size) for k in (1, 2)]


def _slots(order: int, size: int) -> tuple[int, int]:
    """A gram's places in the two tables, ``size`` a power of two, from its order hash."""
    return order & (size - 1), (order >> 32) & (size - 1)


def _ranges(found: DataFrame, per_range: int) -> list[bytes]:
    """Two tables by slot: the logarithm of how many ranges a gram with that slot needs, 0 where none needs more than one."""
    many = found.where(F.col("n") > per_range)
    size = min(SLOTS_MOST, max(SLOTS_LEAST, 1 << (256 * many.count()).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = _mixed(b.column(0).to_numpy().view(np.uint64) + np.uint64(3)).tolist()
            log = [(-(-n // per_range) - 1).bit_length() for n in b.column(1).to_pylist()]
            at = [t * size + s for o in order for t, s in enumerate(_slots(o, size))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.repeat(log, 2), pa.int64())], ["at", "log"])

    tables = np.zeros(2 * size, dtype=np.uint8)
    slots = many.select("h", "n").mapInArrow(placed, "at long, log long").groupBy("at").agg(F.max("log").alias("log")).toArrow()
    tables[slots.column("at").to_numpy()] = slots.column("log").to_numpy()
    return [tables[:size].tobytes(), tables[size:].tobytes()]


def _shared_grams(rows: DataFrame, width: int, gram: int, per_range: int) -> tuple[np.ndarray, int, list[bytes]]:
    """The filter of grams at two anchors or more, how many anchors have one, and the tables of grams with more than one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                found = [anchors(data, width, gram)[1] for _, _, data in _texts(b.slice(at, 500))]
                kinds, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    found = keep(rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "grams")
    kinds, total = found.agg(F.count("*"), F.sum("n")).first()
    hot = _ranges(found, per_range)
    size = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (16 * kinds).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(b.column(0).to_numpy().view(np.uint64), size)).astype(np.int64))], ["bit"])

    words = found.select("h").mapInArrow(placed, "bit long").groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("v")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[words.column("word").to_numpy()] = words.column("v").to_numpy()
    forget(found)
    return bits.view(np.uint64), total or 0, hot


_PARTS = pa.schema([("bucket", pa.int64()), ("sub", pa.int32()), ("heads", pa.binary()), ("rests", pa.binary()), ("lefts", pa.binary())])
_PARTS_DDL = "bucket long, sub int, heads binary, rests binary, lefts binary"


def _cut(entries: list[tuple[bytes, tuple]], depth: int, hot: list[bytes] | None) -> pa.RecordBatch:
    """A sorted run cut at the ranges of its order hash's first ``depth`` bits; ``sub`` counts the ranges of a hot gram from 1."""
    size = len(hot[0]) if hot else 0
    parts: dict[tuple[int, int], list[tuple[bytes, tuple]]] = {}
    for e in entries:
        order = int.from_bytes(e[0][:8], "big")
        if hot and (log := min(t[s] for t, s in zip(hot, _slots(order, size), strict=True))):
            key = (order - (1 << 63), 1 + (int.from_bytes(e[0][-8:], "big") & ((1 << log) - 1)))
        else:
            key = (order >> (64 - depth), 0)
        parts.setdefault(key, []).append(e)
    out = [(*key, *front_coded(part)) for key, part in parts.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 5, _PARTS, strict=True)], schema=_PARTS)


def covered(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, per_range: int = RANGE, fan: int = FAN) -> DataFrame:
    """``did, rid, begin, end``: stretches that together cover what repeats; ``docs`` has ``did, rid, text``."""
    sc = docs.sparkSession.sparkContext
    bits, total, hot = _shared_grams(docs, width, gram, per_range)
    shared = sc.broadcast((bits, hot))
    step, depth = fan.bit_length() - 1, (-(-total // per_range) - 1).bit_length() if total else 0

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        entries: list[tuple[bytes, tuple]] = []
        for b in batches:
            for did, rid, data in _texts(b):
                for e in _suffixes(data, did, rid, bits, width, gram):
                    entries.append(e)
                    if len(entries) >= RUN:
                        yield _cut(sorted(entries, key=lambda e: e[0]), min(step, depth), hot)
                        entries = []
        yield _cut(sorted(entries, key=lambda e: e[0]), min(step, depth), hot)

    def finer(level: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Parts of one range, as they stand together, merged to runs and cut again."""
            held: list[tuple[bytes, bytes, bytes]] = []
            n, at = 0, None

            def sent() -> pa.RecordBatch:
                return _cut([(s, payload) for _, s, payload in merge([decoded(*x) for x in held])], level, None)

            for b in batches:
                for bucket, _, *part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and (bucket != at or n >= RUN):
                        yield sent()
                        held, n = [], 0
                    at = bucket
                    held.append(tuple(part))
                    n += len(part[0]) // _HEAD.itemsize
            yield sent()

        return run

    result = pa.schema([("did", pa.int64()), ("rid", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("w", pa.binary())])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        border = key[1].as_py() > 0
        rows: list[tuple] = []
        group: list[tuple[bytes, tuple]] = []

        def close() -> None:
            if len(group) > 1 or border:
                settled, open_ = repeated(group, width, border)
                rows.extend((*r, None) for r in settled)
                rows.extend(open_)

        columns = [table.column(c).to_pylist() for c in ("heads", "rests", "lefts")]
        for h, s, payload in merge([decoded(*x) for x in zip(*columns, strict=True)]):
            if h < 8 + gram and group:
                close()
                group = []
            group.append((s[8:], payload))
        close()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, result, strict=True)], schema=result)

    sent, levels = docs.mapInArrow(runs, _PARTS_DDL), []
    for level in range(2 * step, depth + step, step):
        sent = keep(sent, "runs")
        levels.append(sent)
        # As many tasks for a range as it takes to give each some twenty runs; a hot gram's parts are final.
        tasks = 1 + total // (20 * RUN * min(fan << (level - 2 * step), 1 << depth))
        wide = sent.where("sub = 0").repartition("bucket", F.pmod(F.xxhash64("heads"), F.lit(tasks))).sortWithinPartitions("bucket")
        sent = sent.where("sub > 0").unionByName(wide.mapInArrow(finer(min(level, depth)), _PARTS_DDL))
    found = keep(sent.groupBy("bucket", "sub").applyInArrow(merged, "did long, rid long, begin long, end long, w binary"), "matches")
    forget(*levels)
    edges = found.where("w IS NOT NULL")
    twice = edges.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return found.where("w IS NULL").drop("w").unionByName(edges.where("did IS NOT NULL").join(twice, "w", "left_semi").drop("w"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, per_range: int = RANGE, fan: int = FAN) -> DataFrame:
    """``doc_id``, the bytes left as ``kept``, ``n_bytes``, ``n_removed`` and ``n_spans``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("did"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    spans = covered(rows.select("did", "rid", "text"), width, gram, per_range, fan)
    spans = spans.groupBy("did", "rid").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out = []
                for t, found in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    data, kept, end, removed, runs = (t.as_py() or "").encode("utf-8", "surrogatepass"), [], 0, 0, 0
                    for s in found or []:
                        if s["begin"] > end or not runs:
                            kept.append(data[end : s["begin"]])
                            runs += 1
                            end = s["begin"]
                        if s["end"] > end:
                            removed += s["end"] - end
                            end = s["end"]
                    kept.append(data[end:])
                    out.append((b"".join(kept), len(data), removed, runs))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    schema = rows.select("doc_id").schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return rows.join(spans, ["did", "rid"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
