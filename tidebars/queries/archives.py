"""Archives of recorded pages and sinks of points, made from the driver's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars import session
from tidebars.queries.tables import TICKS_SQL, bars, bars_sql, round_sql, rounded
from tidebars.sources import archive, exchange, files, points

_PRICES = ["open", "high", "low", "close", "volume"]
_B = f"WITH {TICKS_SQL}, b AS ({bars_sql()})"
_DAY = 24 * 3600 * 1000


def _kline() -> Column:
    """A bar as the interface answers it: an array of texts."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    text = [F.col(c).cast("string") for c in _PRICES]
    return F.array(at.cast("string"), *text, F.lit("0"), (F.col("volume") * 2).cast("string"), F.col("trades").cast("string"), F.lit("0"), F.lit("0"), F.lit("0"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily pages of hourly bars, each with an hour of the next day."""
    return archive.pages_of(bars(spark, sf_dir), _kline(), "1 day", "1 hour")


def _on_wednesdays(pages: DataFrame) -> DataFrame:
    """The pages with those of Wednesdays cut short, as a broken connection leaves them."""
    cut = F.expr("substring(value, 1, length(value) div 2)")
    return pages.withColumn("value", F.when(F.pmod("number", F.lit(7)) == 6, cut).otherwise(F.col("value")))


def _bars_of(pages: DataFrame) -> DataFrame:
    found = exchange.klines(pages, F.col("symbol"), order="number")
    return rounded(found.select("symbol", "ts", "trades", *_PRICES, "quote_volume"))


def page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are recorded, those found damaged are recorded again, and all are read back."""
    path, pages = session.scratch(spark, "archive"), _pages(spark, sf_dir)
    archive.record(_on_wednesdays(pages), path)
    again = archive.read(spark, path).where("problem is not null").select("symbol", "number")
    archive.record(pages.join(again, ["symbol", "number"], "left_semi"), path)
    return _bars_of(archive.read(spark, path))


def page_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collector has to fetch again, where pages are damaged or lack."""
    path = session.scratch(spark, "archive")
    archive.record(_on_wednesdays(_pages(spark, sf_dir)), path)
    return archive.holes(archive.read(spark, path))


def resumed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive as a stream: the second run begins where the first one ended, and reads what was recorded since."""
    path, out, mark = (session.scratch(spark, n) for n in ("archive", "stream", "offsets"))
    pages = _pages(spark, sf_dir)
    halfway = F.lit(19738)  # the day's number of 2024-01-16
    for part in (F.col("number") < halfway, F.col("number") >= halfway):
        archive.record(pages.where(part), path)
        query = archive.read_stream(spark, path).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        query.awaitTermination()
    return _bars_of(spark.read.schema(archive.SCHEMA).parquet(out))


def points_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a backfill that is written twice, and of a stream that goes on where the backfill ends and runs twice."""
    path, rest, mark = (session.scratch(spark, n) for n in ("points", "lines", "offsets"))
    every = bars(spark, sf_dir)
    lines = lambda part: files.line_protocol(every.where(part), "bars", ("symbol",), ("trades",))
    before = "ts < TIMESTAMP_NTZ'2024-01-16 00:00:00'"
    for _ in range(2):
        points.backfill(lines(before), path, "until 2024-01-16")
    lines(f"not {before}").write.parquet(rest)
    for _ in range(2):
        points.follow(spark.readStream.schema("line string").parquet(rest), path, mark).awaitTermination()
    return points.points(spark, path)


QUERIES: dict = {f.__name__: f for f in (page_archive, page_holes, resumed_pages, points_once)}
_KLINES = f"{_B} SELECT symbol, ts, trades, {round_sql(*_PRICES)}, round(volume * 2 + 1.3e-9, 6) + 0.0 AS quote_volume FROM b"
ORACLE_SQL: dict = {
    "page_archive": _KLINES,
    "page_holes": (
        f"{_B}, stamped AS (SELECT symbol, epoch_ms(ts) AS ms FROM b), "
        f"covered AS (SELECT symbol, ms // {_DAY} AS day FROM stamped UNION SELECT symbol, ms // {_DAY} - 1 FROM stamped WHERE ms % {_DAY} < 3600000), "
        f"good AS (SELECT symbol, day * {_DAY} AS page_from, lag(day) OVER (PARTITION BY symbol ORDER BY day) * {_DAY} + {_DAY} + 3600000 AS hole_from FROM covered WHERE day % 7 <> 6) "
        "SELECT symbol, hole_from, page_from AS hole_to FROM good WHERE hole_from < page_from"
    ),
    "resumed_pages": _KLINES,
    "points_once": f"{_B} SELECT 'bars,symbol=' || symbol || ' trades=' || trades || 'i ' || epoch_us(ts) || '000' AS line FROM b",
}
