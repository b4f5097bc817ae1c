"""Bars, ticks and reference series in files, with the names and times that such files come with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIME_NAMES = ("timestamps", "timestamp", "time", "datetime", "date", "open_time", "ts")
PRICES = ("open", "high", "low", "close")


def parse_time(x: Column) -> Column:
    """Seconds or milliseconds since 1970, or a date and time as text (quotes allowed), as a time without zone."""
    text = F.trim(F.translate(x.cast("string"), "\"'", ""))
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) >= 1e11, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), text.try_cast("timestamp")).cast("timestamp_ntz")


def load(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV (with a header), JSON-lines, ORC or Parquet file or folder; kind is taken from the suffix if not given."""
    kind = kind or {"jsonl": "json"}.get(path.rsplit(".", 1)[-1], path.rsplit(".", 1)[-1])
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if schema:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def load_bars(spark: SparkSession, path: str, symbol: str | None = None, keep: str = "last", kind: str | None = None) -> DataFrame:
    """symbol, ts, open, high, low, close, volume: times parsed, rows without prices dropped, one row for each symbol and time.

    keep: "last" or "first" of rows with equal times, in the order of the file.
    """
    df = load(spark, path, kind)
    time = next((c for c in TIME_NAMES if c in df.columns), None)
    missing = [c for c in PRICES if c not in df.columns]
    if time is None or missing:
        raise ValueError(f"{path}: no column of times" if time is None else f"{path}: missing {', '.join(missing)}")
    name = F.col("symbol") if "symbol" in df.columns else F.lit(symbol)
    volume = F.col("volume") if "volume" in df.columns else F.lit(None)
    out = df.select(name.alias("symbol"), parse_time(F.col(time)).alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in PRICES], volume.try_cast("double").alias("volume"), F.monotonically_increasing_id().alias("__at"))
    out = out.dropna(subset=["ts", *PRICES])
    order = F.col("__at").desc() if keep == "last" else F.col("__at")
    first = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(order))
    return out.withColumn("__n", first).where("__n = 1").drop("__n", "__at")


def violations(bars: DataFrame) -> DataFrame:
    """Bars that can't be: symbol, ts and the first rule that each breaks."""
    rule = (
        F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in PRICES]) == 1, "missing price").when(F.col("high") < F.col("low"), "high below low")
        .when((F.col("open") > F.col("high")) | (F.col("open") < F.col("low")), "open out of range").when((F.col("close") > F.col("high")) | (F.col("close") < F.col("low")), "close out of range").when(F.col("volume") < 0, "negative volume")
    )
    return bars.select("symbol", "ts", rule.alias("rule")).where("rule is not null")


def save(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = df.write.format(kind).mode(mode)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def convert(spark: SparkSession, path: str, to: str, kind: str | None = None, into: str = "parquet") -> None:
    """The rows of path in another format."""
    save(load(spark, path, kind), to, into)


def line_protocol(df: DataFrame, measurement: str, tags: tuple[str, ...], fields: tuple[str, ...], ts: str = "ts") -> DataFrame:
    """A line of text for each row, as time-series stores take it: measurement,tags fields nanoseconds. Null fields are left out."""
    escape = lambda c: F.regexp_replace(F.col(c).cast("string"), r"([ ,=])", r"\\$1")
    tag = [F.concat(F.lit(f",{t}="), escape(t)) for t in tags]
    kinds = dict(df.dtypes)
    value = lambda c: F.concat(F.col(c).cast("string"), F.lit("i")) if kinds[c] in ("int", "bigint") else F.col(c).cast("string") if kinds[c] != "string" else F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    shown = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), value(c)) for c in fields])
    nanos = F.unix_micros(F.col(ts).cast("timestamp")).cast("string")
    return df.select(F.concat(F.lit(measurement), *tag, F.lit(" "), shown, F.lit(" "), nanos, F.lit("000")).alias("line"))
