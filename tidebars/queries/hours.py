"""Market sessions of the driver's bars, moved to the weeks in which clocks change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators import market_hours
from tidebars.queries.tables import TICKS_SQL, bars, bars_sql, round_sql, rounded

#: From 9 March to 7 April 2024 the clocks change in New York, in London and in Sydney.
_MOVED = "68 days"


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("ts", F.expr(f"ts + INTERVAL {_MOVED}"))


def session_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market_hours.session_ranges(_moved(spark, sf_dir)))


def session_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market_hours.session_levels(_moved(spark, sf_dir)).select("symbol", "ts", "session", "session_day", "session_high", "session_low", "broken"))


QUERIES: dict = {f.__name__: f for f in (session_ranges, session_levels)}

_LISTED = ", ".join(f"('{n}', {h.begin}, {h.end}, '{h.zone}')" for n, h in market_hours.SESSIONS.items())
_OFFSET = "epoch(timezone(zone, timezone('UTC', {t})) - {t})"
_IN = (
    f"WITH {TICKS_SQL}, b AS ({bars_sql()}), moved AS (SELECT * REPLACE (ts + INTERVAL '{_MOVED}' AS ts) FROM b), listed(session, t0, t1, zone) AS (VALUES {_LISTED}), "
    f"clock AS (SELECT *, ts + to_seconds(CAST({_OFFSET.format(t='ts')} - least({_OFFSET.format(t=chr(34) + 'jan' + chr(34))}, {_OFFSET.format(t=chr(34) + 'jul' + chr(34))}) AS BIGINT)) AS c "
    "FROM (SELECT *, date_trunc('year', ts) + INTERVAL '0 days' AS jan, date_trunc('year', ts) + INTERVAL '6 months' AS jul FROM moved, listed)), "
    "opened AS (SELECT *, CASE WHEN t0 < t1 THEN CASE WHEN m >= t0 AND m < t1 THEN CAST(c AS DATE) END WHEN m >= t0 THEN CAST(c AS DATE) WHEN m < t1 THEN CAST(c AS DATE) - 1 END AS session_day "
    "FROM (SELECT *, hour(c) * 60 + minute(c) AS m FROM clock)), "
    "s AS (SELECT * FROM opened WHERE isodow(session_day) < 6)"
)
_OWN = "OVER (PARTITION BY symbol, session, session_day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ORACLE_SQL: dict = {
    "session_ranges": (
        f"{_IN}, r AS (SELECT symbol, session, session_day, min(ts) AS opened, first(high ORDER BY ts) AS opening_high, first(low ORDER BY ts) AS opening_low, count(*) AS bars, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, "
        "last(close ORDER BY ts) AS close, sum(volume) AS volume FROM s GROUP BY 1, 2, 3) "
        f"SELECT symbol, session, session_day, opened, bars, {round_sql('opening_high', 'opening_low', 'open', 'high', 'low', 'close', 'volume')} FROM r"
    ),
    "session_levels": (
        f"{_IN}, w AS (SELECT symbol, ts, session, session_day, close, max(high) {_OWN} AS session_high, min(low) {_OWN} AS session_low, first(high) {_OWN} AS h, first(low) {_OWN} AS l FROM s) "
        f"SELECT symbol, ts, session, session_day, {round_sql('session_high', 'session_low')}, CASE WHEN close > h THEN 1 WHEN close < l THEN -1 ELSE 0 END AS broken FROM w"
    ),
}
