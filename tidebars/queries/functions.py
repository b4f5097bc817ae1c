"""Table functions called from SQL, over the driver's bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions import sql
from tidebars.queries.tables import TICKS_SQL, bars, bars_sql


def sql_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of rising and falling hours."""
    sql.register(spark)
    side = F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down")
    return spark.sql("SELECT * FROM runs_of(TABLE({b}), 'side')", b=bars(spark, sf_dir).select("symbol", "ts", side.alias("side")))


QUERIES: dict = {"sql_runs": sql_runs}
ORACLE_SQL: dict = {
    "sql_runs": (
        f"WITH {TICKS_SQL}, b AS ({bars_sql()}), s AS (SELECT symbol, ts, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' END AS side FROM b), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, side ORDER BY ts) AS island FROM s) "
        "SELECT symbol, side AS value, min(ts) AS begun, max(ts) AS ended, count(*) AS bars FROM n GROUP BY symbol, side, island"
    ),
}
