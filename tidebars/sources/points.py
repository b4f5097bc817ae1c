"""A sink of points in line protocol that takes backfills and streams, each batch once.

Tasks write files of lines under <path>/lines; the commit of a batch puts the names of its files into
<path>/batches/<batch>.json, in one rename. Only files that a batch names are points: what a failed or repeated
task leaves is never read, and a batch written again takes the place of its first form. Streams number their batches
(option `stream` names the stream, "stream" if not given), a backfill names its own (option `batch`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from tidebars import session
from tidebars.sources.archive import folder_of, put

FORMAT = "point_lines"


@dataclass
class Written(WriterCommitMessage):
    """The file of one task, none if it had no lines."""

    name: str | None
    lines: int


class _Batches:
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        if "path" not in self.options:
            raise ValueError("point_lines needs a path")

    def add(self, rows: Iterator) -> Written:
        system, root = folder_of(self.options["path"])
        out, name, count = None, f"{uuid.uuid4().hex}.lp", 0
        for row in rows:
            if row["line"] is None:
                continue
            if out is None:
                system.create_dir(f"{root}/lines", recursive=True)
                out = system.open_output_stream(f"{root}/lines/{name}")
            out.write(row["line"].encode("utf-8") + b"\n")
            count += 1
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, count)

    def keep(self, messages: list, batch: str) -> None:
        system, root = folder_of(self.options["path"])
        system.create_dir(f"{root}/batches", recursive=True)
        aside = f"{root}/batches/.{uuid.uuid4().hex}"
        names = [m.name for m in messages if m is not None and m.name]
        with system.open_output_stream(aside) as out:
            out.write(json.dumps({"files": names, "lines": sum(m.lines for m in messages if m is not None)}).encode())
        put(system, aside, f"{root}/batches/{quote(batch, safe='')}.json")

    def drop(self, messages: list) -> None:
        system, root = folder_of(self.options["path"])
        for m in messages:
            if m is not None and m.name:
                try:
                    system.delete_file(f"{root}/lines/{m.name}")
                except FileNotFoundError:
                    pass


class _Writer(_Batches, DataSourceWriter):
    def write(self, iterator: Iterator) -> Written:
        return self.add(iterator)

    def commit(self, messages: list) -> None:
        self.keep(messages, "backfill-" + self.options["batch"])

    def abort(self, messages: list) -> None:
        self.drop(messages)


class _StreamWriter(_Batches, DataSourceStreamWriter):
    def write(self, iterator: Iterator) -> Written:
        return self.add(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.keep(messages, f"{self.options.get('stream', 'stream')}-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self.drop(messages)


class PointLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite or "batch" not in {k.lower() for k in self.options}:
            raise ValueError("point_lines is added to, by batches with a name")
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> SparkSession:
    session.ship(spark).dataSource.register(PointLines)
    return spark


def backfill(lines: DataFrame, path: str, batch: str) -> None:
    """Write lines (files.line_protocol) as the batch of that name; the same name again takes its place."""
    register(lines.sparkSession)
    lines.select("line").write.format(FORMAT).mode("append").option("path", path).option("batch", batch).save()


def follow(lines: DataFrame, path: str, checkpoint: str, stream: str = "stream"):
    """The started query that writes a stream of lines, all that there is and then no more."""
    register(lines.sparkSession)
    return lines.select("line").writeStream.format(FORMAT).outputMode("append").option("path", path).option("stream", stream).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def points(spark: SparkSession, path: str) -> DataFrame:
    """(line) of all committed batches; a sink without one has no points."""
    system, root = folder_of(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/batches", allow_not_found=True))
    names = []
    for batch in found:
        if batch.base_name.endswith(".json"):
            with system.open_input_stream(batch.path) as file:
                names += json.loads(file.read())["files"]
    if not names:
        return spark.createDataFrame([], "line string")
    return spark.read.text([f"{path.rstrip('/')}/lines/{n}" for n in names]).withColumnRenamed("value", "line")
