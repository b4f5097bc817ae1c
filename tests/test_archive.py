"""Archives of pages with overlaps, holes and damage; resumed streams; points written twice."""

import json
import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidebars.sources import archive, points

HOUR = 3600 * 1000


def page(path, symbol, number, start, end, text):
    folder = Path(path, f"s-{symbol}")
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{number}-{start}-{end}.json").write_bytes(text if isinstance(text, bytes) else text.encode())


def test_overlapping_missing_and_bad_pages(spark, tmp_path):
    path = str(tmp_path / "a")
    page(path, "x", 0, 0, 2 * HOUR, "[1]")
    page(path, "x", 1, HOUR, 3 * HOUR, "[1, 2]")
    page(path, "x", 2, 3 * HOUR, 4 * HOUR, '{"cut": ')
    page(path, "x", 3, 4 * HOUR, 5 * HOUR, b"\xff\xfe")
    page(path, "x", 4, 5 * HOUR, 6 * HOUR, "")
    page(path, "x", 5, 6 * HOUR, 7 * HOUR, "[3]")
    page(path, "y%2Fz", 9, 0, HOUR, "{}")
    Path(path, "s-x", "notes.txt").write_text("no page")
    Path(path, "s-x", ".half").write_text("[")
    found = archive.read(spark, path, stretch=2 * HOUR)
    rows = {(r["symbol"], r["number"]): (r["value"], r["problem"]) for r in found.collect()}
    assert rows == {("x", 0): ("[1]", None), ("x", 1): ("[1, 2]", None), ("x", 2): (None, "not JSON"), ("x", 3): (None, "not JSON"), ("x", 4): (None, "not JSON"), ("x", 5): ("[3]", None), ("y/z", 9): ("{}", None)}
    assert found.rdd.getNumPartitions() == 5
    assert [tuple(r) for r in archive.holes(found).collect()] == [("x", 3 * HOUR, 6 * HOUR)]
    some = archive.read(spark, path, start=2 * HOUR, end=4 * HOUR)
    assert sorted(r["number"] for r in some.collect()) == [1, 2]
    assert archive.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(PySparkException, match="needs a path"):
        spark.read.format(archive.FORMAT).load().count()


def test_reads_that_fail_are_tried_again(monkeypatch, tmp_path):
    page(tmp_path, "x", 0, 0, 1, "[1]")
    known, waits = archive.recorded(str(tmp_path))[0], []
    monkeypatch.setattr(archive.time, "sleep", waits.append)

    class Failing:
        def __init__(self, times):
            self.times, self.inner = times, archive.folder_of(str(tmp_path))[0]

        def open_input_stream(self, path):
            self.times -= 1
            if self.times >= 0:
                raise OSError("gone")
            return self.inner.open_input_stream(path)

    settings = archive._Settings({"path": str(tmp_path), "retries": "2", "backoff": "1"})
    assert settings.value(Failing(2), known) == ("[1]", None) and waits == [1, 2]
    assert settings.value(Failing(3), known) == (None, "unreadable: OSError")


def test_recorded_pages_come_back(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([("x/ y", h, h * 10) for h in range(50)] + [("", 3, 1)], "symbol string, h int, v int").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600).cast("timestamp_ntz"))
    pages = archive.pages_of(rows, F.col("v"), "1 day", "2 hours")
    archive.record(pages, path)
    archive.record(pages, path)
    found = {(r["symbol"], r["number"]): json.loads(r["value"]) for r in archive.read(spark, path).collect()}
    assert found == {("x/ y", 0): [h * 10 for h in range(26)], ("x/ y", 1): [h * 10 for h in range(24, 50)], ("x/ y", 2): [480, 490], ("", 0): [1]}
    assert not [n for n in os.listdir(Path(path, "s-")) if n.startswith(".") and not n.endswith(".crc")]
    with pytest.raises(PySparkException):
        archive.record(pages.withColumn("number", F.lit(None).cast("long")), path)


def test_a_resumed_stream_reads_each_page_once(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("a", "out", "mark"))

    def run():
        archive.read_stream(spark, path).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination(60)

    page(path, "x", 0, 5 * HOUR, 6 * HOUR, "[0]")
    page(path, "y", 7, 0, HOUR, "[7]")
    run()
    page(path, "x", 1, 0, HOUR, "[1]")  # later, about an earlier time
    page(path, "z", 0, 0, HOUR, "bad")
    run()
    run()
    got = sorted(((r["symbol"], r["number"], r["value"]) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted([("x", 0, "[0]"), ("x", 1, "[1]"), ("y", 7, "[7]"), ("z", 0, None)], key=str)


def test_a_batch_written_twice_leaves_no_double_point(spark, tmp_path):
    path = str(tmp_path / "p")
    assert points.points(spark, path).count() == 0
    lines = lambda a, b: spark.range(a, b, numPartitions=3).select(F.format_string("m v=%di 1", "id").alias("line"))
    points.backfill(lines(0, 10), path, "old/1")
    points.backfill(lines(0, 12), path, "old/1")
    points.backfill(lines(20, 22), path, "b")
    with pytest.raises(PySparkException):
        broken = lines(50, 60).select(F.when(F.col("line").contains("55"), F.raise_error(F.lit("stop"))).otherwise(F.col("line")).alias("line"))
        points.backfill(broken, path, "c")
    assert sorted(r["line"] for r in points.points(spark, path).collect()) == sorted(f"m v={k}i 1" for k in [*range(12), 20, 21])


def test_a_stream_of_points_joins_the_backfill(spark, tmp_path):
    source, path, mark = (str(tmp_path / n) for n in ("source", "p", "mark"))
    frame = lambda a, b: spark.range(a, b).select(F.format_string("m v=%di 1", "id").alias("line"))
    points.backfill(frame(0, 5), path, "all")
    for a in (5, 8):
        frame(a, a + 3).write.mode("append").parquet(source)
        for _ in range(2):
            query = points.follow(spark.readStream.schema("line string").parquet(source), path, mark)
            query.awaitTermination(60)
            assert query.exception() is None
    assert sorted(r["line"] for r in points.points(spark, path).collect()) == sorted(f"m v={k}i 1" for k in range(11))
