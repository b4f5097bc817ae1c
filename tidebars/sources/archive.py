"""Archives of recorded pages as a Spark data source, in batches and as a stream that resumes.

A collector records one file a page, <path>/<symbol>/<number>-<from>-<to>.json: pages of a symbol are numbered in the
order in which they come, and hold the answer for the milliseconds from (inclusive) to (exclusive). Pages may overlap,
lack and be damaged. `register` makes the format "recorded_pages" known; a row is a page:

- read: pages are dealt over tasks by symbol and stretch of time, by their names alone; options `start` and `end`
  (milliseconds) leave out the files of pages outside. Options `retries` and `backoff` (seconds, doubled each time) govern
  reads that fail. A page that isn't JSON, or can't be read at the last try, has a null value and its `problem`.
- stream: the offset is the last number of each symbol, so that a query that starts again from its checkpoint goes on with
  the first page that it hasn't read, whatever time the page is about.
- write: a file a row, written aside and renamed, so that a repeated task leaves one file.

Defined results: a symbol's name is quoted as in a URL, so any name will do, the empty one included; a page recorded again under its number and times takes the
place of the first; a null symbol, number or
time is an error; a null value is written as an empty page, which has a problem; other files in the folder are passed over.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidebars import session

FORMAT = "recorded_pages"
SCHEMA = "symbol string, number long, page_from long, page_to long, value string, problem string"
_NAME = re.compile(r"(\d+)-(-?\d+)-(-?\d+)\.json")
_PREFIX = "s-"


def folder_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path there of a local path or an address of any kind that Arrow knows."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", path) else path)
    return system, inner.rstrip("/")


def put(system: fs.FileSystem, aside: str, name: str) -> None:
    """Rename aside to name, in place of a file that is there; some file systems rename onto nothing alone."""
    try:
        system.move(aside, name)
    except OSError:
        system.delete_file(name)
        system.move(aside, name)


@dataclass(frozen=True)
class Recorded:
    """A page by its file's name."""

    symbol: str
    number: int
    start: int
    end: int
    path: str


class Stretch(InputPartition):
    """The pages that one task reads."""

    def __init__(self, pages: list[Recorded]):
        super().__init__(None)
        self.pages = pages


def recorded(path: str) -> list[Recorded]:
    """Every page of the archive, from names alone; a folder that isn't there has none."""
    system, root = folder_of(path)
    out = []
    for found in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = _NAME.fullmatch(found.base_name)
        above = found.path.rsplit("/", 2)[-2] if "/" in found.path else ""
        if found.type == fs.FileType.File and name and above.startswith(_PREFIX):
            out.append(Recorded(unquote(above[len(_PREFIX) :]), *(int(x) for x in name.groups()), found.path))
    return sorted(out, key=lambda p: (p.symbol, p.start, p.number))


def dealt(pages: list[Recorded], width: int) -> list[Stretch]:
    """Pages by symbol and stretch of width milliseconds."""
    groups: dict[tuple[str, int], list[Recorded]] = {}
    for page in pages:
        groups.setdefault((page.symbol, page.start // width), []).append(page)
    return [Stretch(g) for g in groups.values()]


class _Settings:
    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        if "path" not in given:
            raise ValueError("recorded_pages needs a path")
        self.path = given["path"]
        self.start, self.end = (int(given[k]) if k in given else None for k in ("start", "end"))
        self.width = int(given.get("stretch", 7 * 24 * 3600 * 1000))
        self.retries, self.backoff = int(given.get("retries", 3)), float(given.get("backoff", 0.5))

    def wanted(self) -> list[Recorded]:
        return [p for p in recorded(self.path) if (self.start is None or p.end > self.start) and (self.end is None or p.start < self.end)]

    def rows(self, pages: list[Recorded]) -> Iterator[tuple]:
        system, _ = folder_of(self.path)
        for page in pages:
            value, problem = self.value(system, page)
            yield page.symbol, page.number, page.start, page.end, value, problem

    def value(self, system: fs.FileSystem, page: Recorded) -> tuple[str | None, str | None]:
        wait = self.backoff
        for again in range(self.retries, -1, -1):
            try:
                with system.open_input_stream(page.path) as file:
                    text = file.read().decode("utf-8")
                json.loads(text)
                return text, None
            except OSError as error:
                if not again:
                    return None, f"unreadable: {type(error).__name__}"
                time.sleep(wait)
                wait *= 2
            except (UnicodeDecodeError, ValueError, RecursionError):
                return None, "not JSON"
        raise AssertionError("the last try returns")


class _Reader(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self) -> list[Stretch]:
        return dealt(self.settings.wanted(), self.settings.width)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        # an archive without pages is read as one partition that Spark makes up
        return self.settings.rows(partition.pages if partition is not None else [])


class _StreamReader(DataSourceStreamReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last: dict[str, int] = {}
        for page in self.settings.wanted():
            last[page.symbol] = max(page.number, last.get(page.symbol, -1))
        return last

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return dealt([p for p in self.settings.wanted() if start.get(p.symbol, -1) < p.number <= end.get(p.symbol, -1)], self.settings.width)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return self.settings.rows(partition.pages)


class _Writer(DataSourceWriter):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = folder_of(self.settings.path)
        for row in rows:
            if None in (row["symbol"], row["number"], row["page_from"], row["page_to"]):
                raise ValueError("a page needs a symbol, a number and its times")
            folder = f"{root}/{_PREFIX}{quote(row['symbol'], safe='')}"
            system.create_dir(folder, recursive=True)
            name, aside = f"{folder}/{row['number']}-{row['page_from']}-{row['page_to']}.json", f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as out:
                out.write((row["value"] or "").encode("utf-8"))
            put(system, aside, name)
        return WriterCommitMessage()


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(_Settings(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(_Settings(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("an archive is only added to")
        return _Writer(_Settings(self.options))


def register(spark: SparkSession) -> SparkSession:
    session.ship(spark).dataSource.register(RecordedPages)
    return spark


def pages_of(rows: DataFrame, value: Column, width: str = "1 day", overlap: str = "0 seconds", by: str = "symbol", time: str = "ts") -> DataFrame:
    """Pages of the archive's form from rows: a JSON array of value for each symbol and stretch of width, each page with the
    rows of the overlap after it too. width and overlap: at most a stretch's rows are in a page, which bounds the group."""
    step, over = (int(rows.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {x})").first()[0]) for x in (width, overlap))
    if step <= 0 or not 0 <= over <= step:
        raise ValueError("a page's width is positive and no shorter than the overlap")
    at = F.unix_millis(F.col(time).cast("timestamp"))
    number = F.floor(at / step).cast("long")
    also = F.when((at - number * step < over) & (number > 0), F.array(number, number - 1)).otherwise(F.array(number))
    each = rows.select(F.col(by).alias("symbol"), F.explode(also).alias("number"), at.alias("__at"), value.alias("__v"))
    held = each.groupBy("symbol", "number").agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("__l"))
    first = F.col("number") * step
    return held.select("symbol", "number", first.alias("page_from"), (first + step + over).alias("page_to"), F.to_json(F.transform("__l", lambda x: x["__v"])).alias("value"), F.lit(None).cast("string").alias("problem"))


def record(pages: DataFrame, path: str) -> None:
    """Add pages to the archive."""
    register(pages.sparkSession)
    pages.select("symbol", "number", "page_from", "page_to", "value", "problem").write.format(FORMAT).mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    reader = register(spark).read.format(FORMAT).option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def read_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    reader = register(spark).readStream.format(FORMAT).option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def holes(pages: DataFrame) -> DataFrame:
    """(symbol, hole_from, hole_to): the times between a symbol's first and last page that no readable page covers. Damaged
    pages cover nothing, so what this returns is what a collector has to fetch again."""
    good = pages.where("problem is null and page_to > page_from")
    order = Window.partitionBy("symbol").orderBy("page_from", "page_to", "number")
    so_far = F.max("page_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return good.select("symbol", so_far.alias("hole_from"), F.col("page_from").alias("hole_to")).where("hole_from < hole_to")
