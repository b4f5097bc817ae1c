"""Recorded pages of exchanges' interfaces: each function turns a table of answers, as text, into typed rows.

Answers are collected by whatever calls the interface and kept as files, one answer a row (`load_answers`); there is no
client here. Pages overlap where a collector resumes, so every function keeps one row for each key. Cells that
don't parse become null and rows without a time are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators.relational import union_all
from tidebars.sources.files import load_bars, parse_time

# Names and order of what the interfaces answer with.
KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
TIME_FIELDS = ("timestamp", "time", "fundingTime", "T", "E")


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """(value, path): a row for each line of the files under path; a file is one answer or one answer a line."""
    return spark.read.text(path).select("value", F.input_file_name().alias("path"))


def _number(x: Column) -> Column:
    return x.cast("string").try_cast("double")


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, the one with the largest __at; of rows that differ at the same __at the greatest, column by column."""
    rest = [c for c in rows.columns if c not in keys and c != "__at"]
    out = rows.groupBy(*keys).agg(F.max(F.struct("__at", *rest)).alias("__r"))
    return out.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def klines(answers: DataFrame, symbol: str | Column, value: str = "value", order: str | None = None) -> DataFrame:
    """Bars of pages of arrays of arrays; of bars in several pages the last by `order` stays."""
    row = F.explode(F.from_json(value, "array<array<string>>"))
    cells = answers.select(row.alias("__c"), (F.col(order) if order else F.lit(0)).alias("__at"), (symbol if isinstance(symbol, Column) else F.lit(symbol)).alias("symbol"))
    cell = {n: F.get("__c", F.lit(i)) for i, n in enumerate(KLINE)}
    numbers = [_number(cell[n]).alias(n) for n in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote")]
    typed = cells.select("symbol", parse_time(cell["open_time"]).alias("ts"), *numbers, cell["trades"].try_cast("long").alias("trades"), "__at").where("ts is not null and close is not null")
    return _latest(typed, "symbol", "ts")


def agg_trades(answers: DataFrame, symbol: str, value: str = "value") -> DataFrame:
    """Trades of pages of objects, one for each trade id: price, quantity and which side was the taker's."""
    each = answers.select(F.explode(F.from_json(value, "array<struct<a:bigint,p:string,q:string,f:bigint,l:bigint,T:bigint,m:boolean>>")).alias("t"))
    qty = _number(F.col("t.q"))
    typed = each.select(
        F.lit(symbol).alias("symbol"), F.col("t.a").alias("id"), F.timestamp_millis(F.col("t.T")).cast("timestamp_ntz").alias("ts"), _number(F.col("t.p")).alias("price"), qty.alias("quantity"), F.col("t.m").alias("is_buyer_maker"),
        F.when(F.col("t.m"), 0.0).otherwise(qty).alias("buy_volume"), F.when(F.col("t.m"), qty).otherwise(0.0).alias("sell_volume"), (F.col("t.l") - F.col("t.f") + 1).alias("fills"), F.lit(0).alias("__at"),
    )
    return _latest(typed.where("id is not null and ts is not null"), "symbol", "id")


def depth(answers: DataFrame, symbol: str, value: str = "value") -> DataFrame:
    """Order-book snapshots: bids and asks as arrays of (price, qty); levels that don't parse are left out."""
    d = F.from_json(value, "struct<fetched_at:string,lastUpdateId:bigint,bids:array<array<string>>,asks:array<array<string>>>")
    side = lambda x: F.filter(F.transform(x, lambda v: F.struct(_number(F.get(v, F.lit(0))).alias("price"), _number(F.get(v, F.lit(1))).alias("qty"))), lambda v: v["price"].isNotNull() & v["qty"].isNotNull())
    read = answers.select(d.alias("d"))
    return read.select(F.lit(symbol).alias("symbol"), parse_time(F.col("d.fetched_at")).alias("ts"), F.col("d.lastUpdateId").alias("update_id"), side(F.col("d.bids")).alias("bids"), side(F.col("d.asks")).alias("asks")).where("ts is not null and (bids is not null or asks is not null)")


def series(answers: DataFrame, symbol: str | Column, x: str, name: str, value: str = "value", times: tuple[str, ...] = TIME_FIELDS) -> DataFrame:
    """A sparse series (funding rates, open interest) of objects or arrays of objects: the first time field there is, and x as a number.
    symbol: a name, or a column of answers."""
    wrapped = F.when(F.trim(value).startswith("["), F.col(value)).otherwise(F.concat(F.lit("["), F.col(value), F.lit("]")))
    each = answers.select(F.lit(symbol).alias("symbol"), F.explode(F.from_json(wrapped, "array<map<string,string>>")).alias("m"))
    typed = each.select("symbol", F.coalesce(*[parse_time(F.col("m")[t]) for t in times]).alias("ts"), _number(F.col("m")[x]).alias(name), F.lit(0).alias("__at"))
    return _latest(typed.where("ts is not null"), "symbol", "ts")


def funding(answers: DataFrame, symbol: str | Column, value: str = "value") -> DataFrame:
    return series(answers, symbol, "fundingRate", "funding_rate", value)


def open_interest(answers: DataFrame, symbol: str | Column, value: str = "value") -> DataFrame:
    return series(answers, symbol, "openInterest", "open_interest", value)


def liquidations(answers: DataFrame, symbol: str, value: str = "value") -> DataFrame:
    """Forced orders: a sale closes a long position, a purchase a short one."""
    each = answers.select(F.explode(F.from_json(value, "array<struct<orderId:bigint,side:string,price:string,origQty:string,time:bigint>>")).alias("o"))
    kind = F.when(F.col("o.side") == "SELL", "long").when(F.col("o.side") == "BUY", "short")
    typed = each.select(F.lit(symbol).alias("symbol"), F.col("o.orderId").alias("id"), F.timestamp_millis(F.col("o.time")).cast("timestamp_ntz").alias("ts"), kind.alias("liquidation_type"), _number(F.col("o.price")).alias("price"), _number(F.col("o.origQty")).alias("liquidation_quantity"), F.lit(0).alias("__at"))
    return _latest(typed.where("id is not null and ts is not null"), "symbol", "id")


def quotes(answers: DataFrame, symbol: str | Column, currency: str = "USD", value: str = "value") -> DataFrame:
    """Daily bars nested in data.quotes[].quote.<currency>."""
    kind = f"struct<data:struct<quotes:array<struct<timeOpen:string,quote:struct<`{currency}`:struct<open:double,high:double,low:double,close:double,volume:double>>>>>>"
    q = answers.select(F.lit(symbol).alias("symbol"), F.explode(F.from_json(value, kind)["data"]["quotes"]).alias("q"))
    prices = F.col(f"q.quote.{currency}")
    return q.select("symbol", parse_time(F.col("q.timeOpen")).alias("ts"), *[prices[c].alias(c) for c in ("open", "high", "low", "close", "volume")]).where("ts is not null")


def newer(rows: DataFrame, kept: DataFrame, by: str = "symbol", time: str = "ts") -> DataFrame:
    """The rows after the last time that is kept of each symbol, where an incremental collector goes on."""
    last = kept.groupBy(by).agg(F.max(time).alias("__last"))
    return rows.join(last, by, "left").where(F.col("__last").isNull() | (F.col(time) > F.col("__last"))).drop("__last")


def timeframes(spark: SparkSession, paths: dict[str, str], symbol: str | None = None) -> DataFrame:
    """Bars of several files with `timeframe`; files that aren't there are passed over, and none at all is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = {t: p for t, p in paths.items() if (x := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(x)}
    if not there:
        raise ValueError(f"none of these files exists: {', '.join(paths.values())}")
    return union_all(*[load_bars(spark, p, symbol).withColumn("timeframe", F.lit(t)) for t, p in there.items()])


def save_timeframes(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder timeframe=<t> for each, as Parquet: filters on timeframe then read no other folder."""
    bars.write.partitionBy("timeframe").mode(mode).parquet(path)


@dataclass(frozen=True)
class Settings:
    """What a run is about; `read` takes a mapping, as a settings file gives it, and refuses names that it doesn't know."""

    symbol: str = "BTCUSDT"
    timeframe: str = "15m"
    start: str | None = None
    end: str | None = None
    indicators: tuple[str, ...] = ("rsi_sma", "bollinger")
    fast: tuple[int, ...] = (5, 10, 20)
    slow: tuple[int, ...] = (20, 30, 50)
    shares: dict[str, float] = field(default_factory=lambda: {"train": 0.7, "validation": 0.15})

    @classmethod
    def read(cls, given: dict) -> Settings:
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
