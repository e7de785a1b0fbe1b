"""The log source: round trips, pruned days, cut files, bad lines, streams over restarts."""

import datetime
import gzip
import random

import pytest
from pyspark.sql import functions as F

from tidemill.sources import logs

SCHEMA = "day date, ts timestamp_ntz, id long, name string, x double, ok boolean"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    logs.register(spark)


def events(spark, n, seed=1):
    rng = random.Random(seed)
    names = ["plain", "two words", "", 'quo"te', "a=b", "back\\slash", "new\nline", "漢 é", None, "name=1 id=7"]
    rows = [(datetime.datetime(2024, 1, 1 + rng.randrange(6), rng.randrange(24), 5, 9, 1000 * i % 10**6), i, rng.choice(names), rng.choice([None, 1.5, -2e-7]), rng.choice([True, False, None])) for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, id long, name string, x double, ok boolean")


def read(spark, path, schema=SCHEMA, **options):
    return spark.read.format(logs.NAME).schema(schema).options(**options).load(path)


@pytest.mark.parametrize(("compression", "split"), [("gzip", 1 << 20), ("none", 1 << 20), ("none", 997)])
def test_round_trip(spark, tmp_path, compression, split):
    df = events(spark, 120)
    logs.write(df, str(tmp_path), 1, "ts", "id", "ts", "name", "x", "ok", compression=compression)
    got = read(spark, str(tmp_path), splitBytes=split)
    want = df.select(F.to_date("ts").alias("day"), "ts", "id", "name", "x", "ok")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert read(spark, str(tmp_path), "id long").where("id >= 60").count() == 60


def test_blocks_smaller_than_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "BLOCK", 5)
    store = logs.fs.LocalFileSystem()
    lines = [b"a=1", b"", b"b=" + b"2" * 40, b"c=3", b"dd=4"]
    for end in (b"", b"\n"):
        data = b"\n".join(lines) + end
        (tmp_path / "f.txt").write_bytes(data)
        with gzip.open(tmp_path / "f.txt.gz", "wb") as f:
            f.write(data)
        day = datetime.date(2024, 1, 1)
        for split in range(1, len(data) + 1):
            got = [x for at in range(0, len(data), split) for part in logs._lines(store, logs.Piece(str(tmp_path / "f.txt"), day, at, min(at + split, len(data)))) for x in part]
            assert got == lines, split
        assert [x for part in logs._lines(store, logs.Piece(str(tmp_path / "f.txt.gz"), day, 0, 1)) for x in part] == lines


def test_conditions_on_the_day_open_no_other_files(spark, tmp_path):
    df, path = events(spark, 300), str(tmp_path)
    logs.write(df, path, 1, "ts", "id", "name")
    logs.write(df, path, 2, "ts", "id", "name")
    # A file that can't be read: whoever opens day 3 fails.
    broken = next((tmp_path / "batch=000000002" / "day=2024-01-03").glob("*.gz"))
    broken.write_bytes(b"not gzip at all")
    days = df.groupBy(F.dayofmonth("ts").alias("d")).count().collect()
    n = {r.d: 2 * r["count"] for r in days}
    for condition, kept in (("day = DATE'2024-01-02'", {2}), ("day > DATE'2024-01-04'", {5, 6}), ("day <= DATE'2024-01-02'", {1, 2}), ("day IN (DATE'2024-01-01', DATE'2024-01-06')", {1, 6}), ("NOT day = DATE'2024-01-03' AND day < DATE'2024-01-05'", {1, 2, 4}), ("day >= DATE'2025-01-01'", set())):
        got = read(spark, path, splitBytes=1).where(condition)
        assert got.count() == sum(n[d] for d in kept), condition
        assert got.where("id % 2 = 0").groupBy("day").count().count() == len(kept)
        assert got.rdd.getNumPartitions() == max(1, 2 * len(kept))
    with pytest.raises(Exception, match="(?i)gzip|zlib"):
        read(spark, path).count()


def test_bad_lines_and_values(spark, tmp_path):
    folder = tmp_path / "batch=7" / "day=2024-02-29"
    folder.mkdir(parents=True)
    lines = ["id=1 x=2.5", "no pairs here", "id=two x=3", 'id=3 name="open', "id=4 id=5", 'id=6 name="x id=9" x=', "", "xid=7 id=8", "id=10 x=1\r"]
    (folder / "a.log").write_text("\n".join(lines))
    schema = "day date, id long, x double, name string, line string, _corrupt_record string"
    assert read(spark, str(tmp_path), schema).count() == 0  # not complete
    (tmp_path / "batch=7" / "_SUCCESS").touch()
    got = {r.line: r for r in read(spark, str(tmp_path), schema).collect()}
    assert len(got) == len(lines) and {r.day for r in got.values()} == {datetime.date(2024, 2, 29)}
    assert {k: (r.id, r.x, r.name) for k, r in got.items()} == {
        "id=1 x=2.5": (1, 2.5, None), "no pairs here": (None, None, None), "id=two x=3": (None, 3.0, None), 'id=3 name="open': (None, None, None), "id=4 id=5": (4, None, None),
        'id=6 name="x id=9" x=': (6, None, "x id=9"), "": (None, None, None), "xid=7 id=8": (8, None, None), "id=10 x=1": (10, 1.0, None)}
    assert {k for k, r in got.items() if r._corrupt_record is not None} == {"no pairs here", 'id=3 name="open', ""}
    assert spark.read.format(logs.NAME).load(str(tmp_path)).columns == ["day", "line"]
    assert read(spark, str(tmp_path / "nothing"), schema).count() == 0


def test_stream_over_restarts(spark, tmp_path):
    path, out, df = f"{tmp_path}/in", f"{tmp_path}/out", events(spark, 90)

    def run():
        q = spark.readStream.format(logs.NAME).schema("day date, id long, name string").option("splitBytes", 1000).load(path)
        q = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    logs.write(df.where("id < 30"), path, 0, "ts", "id", "name")
    assert run() == list(range(30))
    logs.write(df.where("id >= 60"), path, 2, "ts", "id", "name")
    (tmp_path / "in" / "batch=000000001").mkdir()  # begun, not complete: the next one waits
    assert run() == list(range(30))
    logs.write(df.where("id BETWEEN 30 AND 59"), path, 1, "ts", "id", "name")
    assert run() == list(range(90))
    assert run() == list(range(90))
