"""Late and repeated events: deduplication within a watermark, and verdicts on each row.

Two mechanisms. ``dedup_within`` is Spark's ``dropDuplicatesWithinWatermark``: it holds an
id until the watermark passes its first time by the bound, so its state is bounded by time, not by the
number of ids; the rows it drops leave no trace. ``triage`` is for when they must: a
stateful processor keyed by id that marks each row ``kept``, ``repeated`` or
``late``, so the three counts add up to the input. Write its rows to a table by verdict
for a side output of late rows.

``triage`` holds one entry for each id, its first time, and forgets it when the watermark
has passed that time by ``remember``. Ids are dealt to ``buckets`` by their hash, and a bucket's entries are one value
of state with one timer: each access to state from Python is a call to Spark, so calls grow with the buckets and batches, not with the rows.
A batch that brings a bucket new ids rewrites that bucket's entries. Entries in state are bounded by the ids within ``remember``, and a task holds one
bucket's rows of a batch and its entries at a time; give more ``buckets`` for more than some 10,000 ids in each. A row is late if its time is at or before the watermark of its
batch; Spark's own operators would drop it unseen, a processor is given it. An
id that comes again after it was forgotten is late, as its time lies behind the watermark, so
nothing is kept twice as long as repeats of an id carry times within ``remember`` of the first.

Rows with a null id are kept each by itself, since they can't be repeats. Rows without a time are late.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.streaming.state import seconds, with_rocksdb

#: Groups of ids with one value of state each.
BUCKETS = 2048


def dedup_within(df: DataFrame, at: str, late: str, *ids: str) -> DataFrame:
    """The first row of each id among those within ``late`` of each other; a batch keeps one row of each id."""
    if not df.isStreaming:
        return df.dropDuplicates(list(ids))
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(list(ids))


class _Triage(StatefulProcessor):
    """Ids of a bucket and their first times, in one value: an Arrow file, so a batch reads and writes it once for all of a bucket's rows."""

    def __init__(self, remember_ms: int) -> None:
        self.remember = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "ids binary, until long")

    def handleInputRows(self, key: Any, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        mark_ms = timerValues.getCurrentWatermarkInMs()
        mark, held = mark_ms * 1000, self.first.get()
        known, until = (_load(held[0]), held[1]) if held else ({}, None)
        new = False
        # Within a batch the earliest row of an id is the one kept, whatever order the batch has.
        for r in sorted(rows, key=lambda r: (r["_us"] is None, r["_us"])):
            us, i = r["_us"], r["_id"]
            verdict = "late" if us is None or us <= mark else "repeated" if i in known else "kept"
            if verdict == "kept" and i is not None:
                known[i], new = us, True
            yield Row(_row=r["_row"], verdict=verdict)
        if new:
            self._store(known, until, mark_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self.first.get()
        if held and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self._store(_load(held[0]), None, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _store(self, known: dict, until: int | None, mark_ms: int) -> None:
        """Keeps the ids that the watermark hasn't forgotten. The bucket's one timer is for the first of them."""
        ends = lambda us: us // 1000 + 1 + self.remember
        if until is None or until <= mark_ms:
            known = {i: us for i, us in known.items() if ends(us) > mark_ms}
        if not known:
            self.first.clear()
            return
        first = ends(min(known.values()))
        if until is None or until <= mark_ms or first < until:
            until = first
            self.handle.registerTimer(first)
        self.first.update((_dump(known), until))

    def close(self) -> None:
        pass


def _dump(known: dict) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"id": pa.array(list(known)), "us": pa.array(list(known.values()), pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _load(held: bytes) -> dict:
    table = pa.ipc.open_stream(bytes(held)).read_all()
    return dict(zip(table.column("id").to_pylist(), table.column("us").to_pylist(), strict=True))


def triage(stream: DataFrame, event_id: str, at: str, late: str, remember: str, buckets: int = BUCKETS) -> DataFrame:
    """``stream`` with ``verdict``: kept, repeated or late. ``remember``: how far apart in time repeats of an id can be."""
    with_rocksdb(stream.sparkSession)
    names = stream.columns
    # Null ids never repeat; spreading them keeps them from one task.
    bucket = F.pmod(F.when(F.col(event_id).isNull(), F.xxhash64(*names)).otherwise(F.xxhash64(event_id)), F.lit(buckets)).cast("int")
    rows = stream.withWatermark(at, late).select(bucket.alias("_bucket"), F.col(event_id).alias("_id"), F.unix_micros(at).alias("_us"), F.struct(*names).alias("_row"))
    row_type = rows.schema["_row"].dataType.simpleString()
    out = rows.groupBy("_bucket").transformWithState(_Triage(seconds(remember) * 1000), f"_row {row_type}, verdict string", "append", "eventTime")
    return out.select("_row.*", "verdict")
