"""Bars of a stream of ticks, by event time: the definitions of `resample`, with a watermark for late ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators.resample import duration


def stream_bars(ticks: DataFrame, timeframe: str, late: str = "10 minutes", tie: str = "id") -> DataFrame:
    """symbol, ts, open, high, low, close, volume, trades of each bar that the watermark has passed. ticks: symbol, ts, price, qty, tie.

    Only sums and extremes are held as state, one row for each open bar.
    """
    at = F.struct("ts", tie)
    out = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.window("ts", duration(timeframe)).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trades")
    )
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def stream_flow(trades: DataFrame, timeframe: str, late: str = "10 minutes") -> DataFrame:
    """Sums of buys and sells, trades and the last price of each bar that the watermark has passed."""
    out = trades.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.window("ts", duration(timeframe)).alias("w")).agg(
        F.sum("buy_volume").alias("buy_volume"), F.sum("sell_volume").alias("sell_volume"), F.count("*").alias("trades"), F.max_by("price", F.struct("ts", "id")).alias("last_price")
    )
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "buy_volume", "sell_volume", "trades", "last_price")


def closed_candles(candles: DataFrame) -> DataFrame:
    """Candles that the exchange has closed, each once. candles: symbol, ts, is_closed and the prices."""
    return candles.where("is_closed").withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["symbol", "ts"])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that the stream's source has now, appended as Parquet to path; restarts go on where the last run ended."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def stream_depth(snapshots: DataFrame, timeframe: str, shares: tuple[float, ...] = (0.03, 0.08, 0.15, 0.6), late: str = "10 minutes") -> DataFrame:
    """Of each bar that the watermark has passed, its last snapshot: the volume of bids and asks within each share of the
    middle price, and their imbalance. snapshots: symbol, ts, bids, asks (arrays of price and qty, best first)."""
    best = lambda x: F.get(F.col(x), F.lit(0))["price"]
    middle = (best("bids") + best("asks")) / 2
    near = lambda x, s: F.aggregate(F.filter(F.col(x), lambda v: F.abs(v["price"] / middle - 1) <= s), F.lit(0.0), lambda t, v: t + v["qty"])
    named = {f"{side}_{round(100 * s)}": near(f"{side}s", s) for s in shares for side in ("bid", "ask")}
    banded = snapshots.select("symbol", F.col("ts").cast("timestamp").alias("ts"), *[v.alias(n) for n, v in named.items()])
    last = banded.withWatermark("ts", late).groupBy("symbol", F.window("ts", duration(timeframe)).alias("w")).agg(F.max_by(F.struct(*named), "ts").alias("b"), F.count("*").alias("snapshots"))
    shown = last.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "snapshots", *[F.col(f"b.{n}").alias(n) for n in named])
    whole = lambda p: F.col(f"bid_{p}") + F.col(f"ask_{p}")
    return shown.withColumns({f"imbalance_{p}": (F.col(f"bid_{p}") - F.col(f"ask_{p}")) / F.when(whole(p) != 0, whole(p)) for p in (round(100 * s) for s in shares)})


def stream_liquidations(orders: DataFrame, timeframe: str, late: str = "10 minutes") -> DataFrame:
    """Quantities of forced orders of long and short positions in each bar that the watermark has passed."""
    of = lambda kind: F.sum(F.when(F.col("liquidation_type") == kind, F.col("liquidation_quantity")).otherwise(0.0))
    out = orders.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.window("ts", duration(timeframe)).alias("w")).agg(of("long").alias("long_liquidations"), of("short").alias("short_liquidations"), F.sum("liquidation_quantity").alias("total_liquidations"))
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "long_liquidations", "short_liquidations", "total_liquidations")


def stream_sliding(ticks: DataFrame, length: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Mean price and volume of windows of `length` that begin every `step`."""
    out = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.window("ts", duration(length), duration(step)).alias("w")).agg(F.avg("price").alias("mean_price"), F.sum("qty").alias("volume"), F.count("*").alias("trades"))
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "mean_price", "volume", "trades")


def stream_sessions(ticks: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Stretches of trading without a pause of `gap`: bounds, volume and trades."""
    out = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.session_window("ts", duration(gap)).alias("w")).agg(F.sum("qty").alias("volume"), F.count("*").alias("trades"))
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "volume", "trades")
