"""Ticks, trades, snapshots and bars into bars of any timeframe. Bars are labelled by their start and half-open."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.frames import carry, safe

#: 'M' stands for minutes in bar names and for months in exchange intervals.
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def duration(name: str) -> str:
    """'15m', '1H' or '5 minutes' as an interval for window()."""
    if found := re.fullmatch(r"\s*(\d+)\s*([smhdwSMHDW])\s*", name):
        return f"{found[1]} {_UNITS[found[2].lower()]}"
    return name


def seconds(name: str) -> int:
    """The length of an exchange interval ('5m', '1h', '1d', '1w') in seconds."""
    sizes = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
    n, unit = duration(name).split()
    return int(n) * sizes[unit if unit.endswith("s") else unit + "s"]


def bin_start(timeframe: str, start: str | None = None, ts: str = "ts") -> Column:
    """The start of the bar of ts. Weeks begin on Monday; start shifts days, e.g. '3 hours' for UTC-3."""
    size = duration(timeframe)
    if size.split()[1].startswith("week") and start is None:
        start = "4 days"
    return F.window(ts, size, size, start)["start"] if start else F.window(ts, size)["start"]


def ticks_to_bars(ticks: DataFrame, timeframe: str, start: str | None = None, tie: str = "id", price: str = "price", qty: str = "qty") -> DataFrame:
    """symbol, ts, open, high, low, close, volume, trades; ticks of equal time are ordered by tie."""
    at = F.struct("ts", tie)
    return ticks.groupBy("symbol", bin_start(timeframe, start).alias("bin")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(qty).alias("volume"), F.count("*").alias("trades")
    ).withColumnRenamed("bin", "ts")


def bars_to_bars(bars: DataFrame, timeframe: str, start: str | None = None) -> DataFrame:
    """Bars of a longer timeframe: first, max, min, last and sums."""
    sums = [F.sum(c).alias(c) for c in ("volume", "trades", "quote_volume", "taker_buy_base", "taker_buy_quote") if c in bars.columns]
    return bars.groupBy("symbol", bin_start(timeframe, start).alias("bin")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), *sums
    ).withColumnRenamed("bin", "ts")


def flow_bars(trades: DataFrame, timeframe: str) -> DataFrame:
    """Sums of buys and sells of each bar. trades: buy_volume, sell_volume, quantity, price."""
    out = trades.groupBy("symbol", bin_start(timeframe).alias("bin")).agg(
        F.sum("buy_volume").alias("buy_volume"), F.sum("sell_volume").alias("sell_volume"), F.sum("quantity").alias("quantity"), F.avg("price").alias("avg_price"), F.count("*").alias("trades")
    ).withColumnRenamed("bin", "ts")
    total = F.col("buy_volume") + F.col("sell_volume")
    return out.select("*", total.alias("total_volume"), (F.col("buy_volume") / F.when(F.col("sell_volume") == 0, 1.0).otherwise(F.col("sell_volume"))).alias("buy_sell_ratio"))


def tick_features(trades: DataFrame, timeframe: str, tie: str = "id") -> DataFrame:
    """Micro-structure of each bar: volume, VWAPs, taker ratio, imbalance and the largest tick return within it.

    The previous tick is looked for within the bar, so that a bar is the largest group of any sort. A step from or to
    a price of 0 is infinite, one between two such prices or across 0 NaN, as floating point has it.
    """
    from pyspark.sql.window import Window

    price, inf = F.col("price"), float("inf")
    binned = trades.withColumn("bin", bin_start(timeframe))
    within = Window.partitionBy("symbol", "bin").orderBy("ts", tie)
    last = F.lag("price").over(within)
    ratio = F.when(last != 0, price / last).when(last == 0, F.when(price > 0, price * inf).otherwise(price * math.nan))
    step = F.when(ratio > 0, F.abs(F.log(ratio))).when(ratio == 0, inf).when(ratio < 0, math.nan)
    taker = F.when(~F.col("is_buyer_maker"), F.col("qty")).otherwise(0.0)
    out = binned.withColumns({"step": step, "taker": taker}).groupBy("symbol", "bin").agg(
        F.count("*").alias("trades"), F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("amount"),
        F.sum("taker").alias("taker_buy"), F.sum(F.col("price") * F.col("taker")).alias("taker_amount"), F.max("step").alias("max_tick_return"),
    )
    return out.select(
        "symbol", F.col("bin").alias("ts"), "trades", "volume", safe(F.col("amount"), F.col("volume")).alias("vwap"), safe(F.col("taker_amount"), F.col("taker_buy")).alias("vwap_taker"),
        safe(F.col("taker_buy"), F.col("volume")).alias("taker_ratio"), safe(2 * F.col("taker_buy") - F.col("volume"), F.col("volume")).alias("imbalance"), "max_tick_return",
    )


def fill_gaps(bars: DataFrame, timeframe: str) -> DataFrame:
    """A row for every bar between a symbol's first and last: flat at the last close, with volume 0, where there was none."""
    size = duration(timeframe)
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    grid = ends.select("symbol", F.explode(F.sequence("first", "last", F.expr(f"interval {size}"))).alias("ts"))
    joined = grid.join(bars, ["symbol", "ts"], "left").withColumn("close", carry(F.col("close")))
    flat = {c: F.coalesce(c, "close") for c in ("open", "high", "low")}
    sums = {c: F.coalesce(c, F.lit(0)) for c in ("volume", "trades") if c in bars.columns}
    return joined.withColumns(flat | sums).select(bars.columns)


def book_features(depth: DataFrame, bands: tuple[int, ...] = (3, 8, 15, 60)) -> DataFrame:
    """Best prices, spread, and volumes within so many percent of the mid price. depth: bids, asks, best first."""
    bid, ask = F.try_element_at("bids", F.lit(1))["price"], F.try_element_at("asks", F.lit(1))["price"]
    out = depth.withColumns({"best_bid": bid, "best_ask": ask}).withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    out = out.withColumn("spread_pct", safe(F.col("best_ask") - F.col("best_bid"), F.col("mid")))
    for band in bands:
        low, high = F.col("mid") * (1 - band / 100), F.col("mid") * (1 + band / 100)
        for name, side, near in ((f"bid_{band}", "bids", lambda x: x["price"] >= low), (f"ask_{band}", "asks", lambda x: x["price"] <= high)):
            out = out.withColumn(name, F.aggregate(F.filter(side, near), F.lit(0.0), lambda s, x: s + x["qty"]))
        both = F.col(f"bid_{band}") + F.col(f"ask_{band}")
        out = out.withColumn(f"imbalance_{band}", F.coalesce(safe(F.col(f"bid_{band}") - F.col(f"ask_{band}"), both), F.lit(0.0)))
    return out


def last_in_bin(rows: DataFrame, timeframe: str, *columns: str, tie: str | None = None) -> DataFrame:
    """The last values of columns in each bar."""
    at = F.struct("ts", tie) if tie else F.col("ts")
    last = rows.groupBy("symbol", bin_start(timeframe).alias("bin")).agg(F.max_by(F.struct(*columns), at).alias("last"))
    return last.select("symbol", F.col("bin").alias("ts"), "last.*")


def aggregate_window(points: DataFrame, timeframe: str, fn: str) -> DataFrame:
    """Of long points (measurement, symbol, field, ts, value): one value for each series and bar that has any."""
    pick = {"last": F.max_by("value", "ts"), "first": F.min_by("value", "ts"), "max": F.max("value"), "min": F.min("value"), "sum": F.sum("value"), "mean": F.avg("value"), "count": F.count("value").cast("double")}[fn]
    return points.groupBy("measurement", "symbol", "field", bin_start(timeframe).alias("bin")).agg(pick.alias("value")).withColumnRenamed("bin", "ts")


def pivot_fields(points: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each (symbol, ts) with a column for each field. The fields are named, so that no scan finds them."""
    return points.groupBy("symbol", "ts").pivot("field", fields).agg(F.first("value", ignorenulls=True))


def unpivot_fields(rows: DataFrame, measurement: str, fields: list[str], keep_null: bool = False) -> DataFrame:
    """Long points of wide rows; null fields are left out, or written as 0 with keep_null."""
    long = rows.unpivot(["symbol", "ts"], fields, "field", "value").withColumn("measurement", F.lit(measurement))
    long = long.withColumn("value", F.coalesce("value", F.lit(0.0))) if keep_null else long.where(F.col("value").isNotNull())
    return long.select("measurement", "symbol", "field", "ts", "value")
