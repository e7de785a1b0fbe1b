"""Partitioned log files as a source for batches and streams, by the Python Data Source API.

*Format.* Lines of ``key=value`` pairs, one space between them; a value that is empty or holds
a space, a quote, ``=`` or a control character is a JSON string. Files, gzipped or plain, stand in
``<path>/batch=<number>/day=<yyyy-MM-dd>/``, and a batch counts once its folder has ``_SUCCESS``,
so a half-written batch is never read. ``write`` makes such folders; a batch written again replaces itself.

*Reading.* ``spark.read.format("tidemill_logs").schema(...).load(path)`` gives the columns asked for and
parses no others: ``day`` from the folder, ``line`` the whole line, ``_corrupt_record`` a line that
isn't of the format, and any other name the key's value, cast. Keys that a line lacks and values that don't cast are null; of a
repeated key the first counts; a line not of the format has nulls in all key columns. A key named like one of the three special columns can't be read.
Without a schema, rows are ``day, line``.

*Planning.* Conditions on ``day`` are taken over from Spark and drop folders before any file is
opened. Files are dealt to tasks of about ``splitBytes``: small ones together, large plain ones cut at lines.
A task streams its files in blocks, so its memory is bounded by a block and the longest line.

*Streams.* ``spark.readStream`` reads whole batches in the order of their numbers; the
offset is the number of the last one. A batch still being written holds back those after it.

The path is any that pyarrow opens on the driver and the executors alike.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "tidemill_logs"
SPLIT = 128 << 20
BLOCK = 4 << 20

_PAIR = r'[^ ="]+=(?:"(?:[^"\\]|\\.)*"|[^ ="]*)'
_COMPARED: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    IsNotNull: lambda a, b: True,
}


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets Spark hand it conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)


def line(df: DataFrame, *columns: str) -> Column:
    """The line of a row; null values are left out."""

    def pair(name: str) -> Column:
        kind = df.schema[name].dataType.simpleString()
        value = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind.startswith("timestamp") else F.col(name).cast("string")
        quoted = F.to_json(F.struct(value.alias("v")))
        plain = value.rlike(r'^[^\x00-\x20"=]+$')
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), F.when(plain, value).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))))

    return F.concat_ws(" ", *map(pair, columns))


def write(df: DataFrame, path: str, batch: int, day: Column | str, *columns: str, compression: str = "gzip") -> None:
    """``columns`` of ``df`` as the lines of a batch, in a folder for each day."""
    rows = df.select(F.to_date(day).alias("day"), line(df, *columns).alias("value")).where("day IS NOT NULL")
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").option("compression", compression).text(f"{path}/batch={batch:09d}")


@dataclass
class Piece:
    """Bytes of a file: the lines that start from ``begin`` on and before ``end``."""

    path: str
    day: datetime.date
    begin: int
    end: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        super().__init__(None)
        self.pieces = pieces


def _batches(path: str) -> list[tuple[int, str, bool]]:
    """Number, folder and completeness of the batches below a path, in order."""
    store, root = fs.FileSystem.from_uri(path)
    found = []
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.type == fs.FileType.Directory and f.base_name.startswith("batch="):
            whole = store.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File
            found.append((int(f.base_name[6:]), f.path, whole))
    return sorted(found)


def _plan(path: str, folders: list[str], tests: list[Callable[[datetime.date], bool]], split: int) -> list[InputPartition]:
    """Files of the days that pass, dealt to tasks."""
    store, _ = fs.FileSystem.from_uri(path)
    pieces = []
    for folder in folders:
        for d in store.get_file_info(fs.FileSelector(folder)):
            if not d.base_name.startswith("day="):
                continue
            day = datetime.date.fromisoformat(d.base_name[4:])
            if not all(t(day) for t in tests):
                continue
            for f in store.get_file_info(fs.FileSelector(d.path)):
                if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._":
                    step = f.size if f.extension == "gz" else split
                    pieces += [Piece(f.path, day, at, min(at + step, f.size)) for at in range(0, f.size, step)]
    out: list[list[Piece]] = []
    room = 0
    for p in sorted(pieces, key=lambda p: (p.day, p.path, p.begin)):
        n = p.end - p.begin
        if n > room:
            out.append([])
            room = split
        out[-1].append(p)
        room -= n
    return [Pieces(p) for p in out]


def _lines(store: fs.FileSystem, piece: Piece) -> Iterator[list[bytes]]:
    """The lines of a piece, a block at a time."""
    at, rest = piece.begin, []
    skip = piece.begin > 0
    with store.open_input_stream(piece.path, compression="gzip") if piece.path.endswith(".gz") else store.open_input_file(piece.path) as f:
        whole = piece.path.endswith(".gz")
        if skip:
            f.seek(piece.begin - 1)
            at = piece.begin - 1
        while block := f.read(BLOCK):
            if skip:
                cut = block.find(b"\n")
                if cut < 0:
                    at += len(block)
                    continue
                at, block, skip = at + cut + 1, block[cut + 1 :], False
            *done, tail = block.split(b"\n")
            if not done:
                rest.append(tail)
                continue
            done[0], rest = b"".join([*rest, done[0]]), [tail]
            if not whole:
                inside = []
                for x in done:
                    if at >= piece.end:
                        break
                    inside.append(x)
                    at += len(x) + 1
                yield inside
                if at >= piece.end:
                    return
            else:
                yield done
    last = b"".join(rest)
    if last and (whole or at < piece.end):
        yield [last]


def _values(lines: pa.Array, key: str) -> pa.Array:
    """The values of a key, quotes taken off; null where a line hasn't the key."""
    name = "".join(f"\\x{{{ord(c):x}}}" for c in key)
    got = pc.extract_regex(lines, rf'(?s)^(?:{_PAIR} )*?{name}=(?P<v>"(?:[^"\\]|\\.)*"|[^ ="]*)(?: |$)')
    raw = pc.struct_field(got, "v")
    quoted = pc.fill_null(pc.starts_with(raw, '"'), False)
    if not pc.any(quoted).as_py():
        return raw

    def plain(x: str) -> str | None:
        try:
            return json.loads(x)
        except ValueError:
            return None

    return pa.array([plain(x) if q else x for x, q in zip(raw.to_pylist(), quoted.to_pylist(), strict=True)], pa.string())


def _cast(values: pa.Array, kind: pa.DataType) -> pa.Array:
    try:
        return pc.cast(values, kind)
    except pa.ArrowInvalid:
        out = []
        for v in values:
            try:
                out.append(pc.cast(v, kind).as_py())
            except pa.ArrowInvalid:
                out.append(None)
        return pa.array(out, kind)


def _read(path: str, schema: pa.Schema, pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
    store, _ = fs.FileSystem.from_uri(path)
    for piece in pieces:
        for block in _lines(store, piece):
            if not block:
                continue
            lines = pa.array([x.decode("utf-8", "replace").removesuffix("\r") for x in block], pa.string())
            good = pc.match_substring_regex(lines, rf"(?s)^{_PAIR}(?: {_PAIR})*$")
            nothing = pa.scalar(None, pa.string())
            parsed = pc.if_else(good, lines, nothing)
            columns = []
            for field in schema:
                if field.name == "day":
                    columns.append(pa.array([piece.day] * len(lines), pa.date32()).cast(field.type))
                elif field.name == "line":
                    columns.append(lines)
                elif field.name == "_corrupt_record":
                    columns.append(pc.if_else(good, nothing, lines))
                else:
                    columns.append(_cast(_values(parsed, field.name), field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "day date, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogStreamReader(self.options, schema)


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        self.schema = to_arrow_schema(schema)
        self.taken: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes over the conditions on the day and leaves the others to Spark."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if type(inner) in _COMPARED and inner.attribute == ("day",) and not (isinstance(f, Not) and isinstance(inner, IsNotNull)):
                self.taken.append(f)
            else:
                yield f

    def _tests(self) -> list[Callable[[datetime.date], bool]]:
        def test(f: Filter) -> Callable[[datetime.date], bool]:
            if isinstance(f, Not):
                inner = test(f.child)
                return lambda day: not inner(day)
            return lambda day: _COMPARED[type(f)](day, getattr(f, "value", None))

        return [test(f) for f in self.taken]

    def partitions(self) -> list[InputPartition]:
        return _plan(self.path, [folder for _, folder, whole in _batches(self.path) if whole], self._tests(), self.split) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.schema, partition.pieces)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        self.schema = to_arrow_schema(schema)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        last = -1
        for n, _, whole in _batches(self.path):
            if not whole:
                break
            last = n
        return {"batch": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _plan(self.path, [folder for n, folder, _ in _batches(self.path) if start["batch"] < n <= end["batch"]], [], self.split)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.schema, partition.pieces)
