"""The library's tables derived from the driver's: ticks and bars from events, daily bars from orders and line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars import session
from tidebars.operators import resample

DIGITS = 6
#: Added before rounding, so that values halfway between two roundings go the same way in both engines.
NUDGE = 1.3e-9


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event type is a symbol, its value a price and, of the same size, a quantity."""
    events = read(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("value").alias("qty"), F.col("event_id").alias("id"))


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    return resample.ticks_to_bars(ticks(spark, sf_dir), timeframe)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as trades of one symbol; purchases and sign-ups buy, errors and views sell."""
    events = read(spark, sf_dir, "events")
    kind, qty = F.col("event_type"), F.col("value")
    return events.select(
        F.lit("ALL").alias("symbol"), "ts", F.col("value").alias("price"), qty.alias("quantity"), F.when(kind.isin("purchase", "signup"), qty).otherwise(0.0).alias("buy_volume"),
        F.when(kind.isin("error", "view"), qty).otherwise(0.0).alias("sell_volume"), kind.isin("error", "view").alias("is_buyer_maker"), qty.alias("qty"), F.col("event_id").alias("id"),
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """df with its doubles rounded, so that sums in another order still compare."""
    names = columns or [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(F.col(c) + NUDGE, DIGITS) + F.lit(0.0) for c in names})


def day(x: Column | str) -> Column:
    return F.date_trunc("day", x)


# --- the same in DuckDB

TICKS_SQL = "e AS (SELECT event_type AS symbol, ts, value AS price, value AS qty, event_id AS id FROM events)"


def bars_sql(interval: str = "1 hour", source: str = "e") -> str:
    return (
        f"SELECT symbol, time_bucket(INTERVAL '{interval}', ts) AS ts, first(price ORDER BY ts, id) AS open, max(price) AS high, min(price) AS low, "
        f"last(price ORDER BY ts, id) AS close, sum(qty) AS volume, count(*) AS trades FROM {source} GROUP BY 1, 2"
    )


def round_sql(*columns: str) -> str:
    return ", ".join(f"round({c} + {NUDGE}, {DIGITS}) + 0.0 AS {c}" for c in columns)


def staged_sql(stages: list[dict[str, str]], outputs: list[str], interval: str = "1 hour", plain: tuple[str, ...] = ()) -> str:
    """Bars, then the columns of each stage over the one before; outputs are rounded, those in plain are not."""
    ctes = [TICKS_SQL, f"s0 AS ({bars_sql(interval)})"]
    for k, stage in enumerate(stages, 1):
        ctes.append(f"s{k} AS (SELECT *, " + ", ".join(f"{expr} AS {name}" for name, expr in stage.items()) + f" FROM s{k - 1})")
    chosen = ["symbol", "ts", *([round_sql(*outputs)] if outputs else []), *plain]
    return "WITH " + ", ".join(ctes) + f" SELECT {', '.join(chosen)} FROM s{len(stages)}"


def over(first: int, last: int = 0) -> str:
    def edge(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"

    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {edge(first)} AND {edge(last)})"


def roll(agg: str, x: str, n: int, shift: int = 0, least: int | None = None) -> str:
    w = over(-(n - 1) - shift, -shift)
    call = agg.format(x=x) if "{x}" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) OVER {w} >= {n if least is None else least} THEN {call} OVER {w} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def carry(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def run(agg: str, x: str) -> str:
    return f"{agg}({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ema(x: str, alpha: float) -> str:
    """The recursive exponential mean, seeded with the first value that isn't null."""
    everything = f"list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"list_reduce({everything}, lambda a, z: a * {1 - alpha!r} + z * {alpha!r})"


def ema_adjusted(x: str, alpha: float) -> str:
    """The exponential mean with weights normed over the values so far."""
    everything = f"list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"list_reduce({everything}, lambda a, z: a * {1 - alpha!r} + z) * {alpha!r} / (1 - {1 - alpha!r} ** {run('count', x)})"


def wilder(x: str, n: int) -> str:
    return f"CASE WHEN {run('count', x)} >= {n} THEN {ema(x, 1 / n)} END"


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
