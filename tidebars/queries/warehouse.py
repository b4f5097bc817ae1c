"""Files, line protocol and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars import session
from tidebars.queries.tables import TICKS_SQL, bars, bars_sql, read, rounded, round_sql
from tidebars.sources import files
from tidebars.streaming import bars as streams

_B = f"WITH {TICKS_SQL}, b AS ({bars_sql()})"
_PRICES = ("open", "high", "low", "close", "volume")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as CSV and read back by the validating reader."""
    path = session.scratch(spark, "bars")
    files.save(bars(spark, sf_dir), path, "csv")
    return rounded(files.load_bars(spark, path, kind="csv"))


def line_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.line_protocol(bars(spark, sf_dir), "bars", ("symbol",), ("trades",))


def bar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = bars(spark, sf_dir).withColumn("close", F.when(F.col("trades") == 3, F.col("high") + 1).otherwise(F.col("close")))
    return files.violations(shifted)


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events as a stream: those that the watermark has passed when all are read."""
    kind = read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ticks = events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("value").alias("qty"), F.col("event_id").alias("id"))
    return rounded(streams.run_available(streams.stream_bars(ticks, "1h"), session.scratch(spark, "stream"), session.scratch(spark, "offsets")))


QUERIES: dict = {f.__name__: f for f in (csv_round_trip, line_protocol, bar_violations, stream_bars)}
ORACLE_SQL: dict = {
    "csv_round_trip": f"{_B} SELECT symbol, ts, {round_sql(*_PRICES)} FROM b",
    "line_protocol": f"{_B} SELECT 'bars,symbol=' || symbol || ' trades=' || trades || 'i ' || epoch_us(ts) || '000' AS line FROM b",
    "bar_violations": f"{_B} SELECT symbol, ts, 'close out of range' AS rule FROM b WHERE trades = 3",
    "stream_bars": f"{_B} SELECT symbol, ts, {round_sql(*_PRICES)}, trades FROM b WHERE ts + INTERVAL '1 hour' <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '10 minutes' FROM events)",
}
