"""Splits of histories in time, and what repeats of a measurement say about it.

A fold table has a row for each symbol and fold, with bounds in row numbers [from, to). It follows from each symbol's
row count alone, so it is small and is broadcast to the numbered bars; nothing is fitted here.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.frames import ordered, safe

BOUNDS = ("train_from", "train_to", "test_from", "test_to")


def numbered(bars: DataFrame) -> DataFrame:
    """bars with __row, counted from 0 in each symbol."""
    return bars.withColumn("__row", F.row_number().over(ordered()).cast("long") - 1)


def _folds(bars: DataFrame, fold: Column, **bounds: Column) -> DataFrame:
    counts = bars.groupBy("symbol").agg(F.count("*").alias("__n"))
    table = counts.withColumn("fold", F.explode(fold)).withColumns({k: v.cast("long") for k, v in bounds.items()})
    return table.where((F.col("test_to") <= F.col("__n")) & (F.col("train_to") > F.col("train_from")) & (F.col("test_to") > F.col("test_from"))).drop("__n")


def _share(n: Column, parts: int) -> Column:
    return F.floor(n / parts)


def purged(bars: DataFrame, splits: int = 5, purge: int = 5, embargo: int = 5) -> DataFrame:
    """Training grows from the beginning; a gap of `purge` rows parts it from the test, which gives up its last `embargo` rows."""
    size, end = _share(F.col("__n"), splits + 1), (F.col("fold") + 1) * _share(F.col("__n"), splits + 1)
    return _folds(bars, F.sequence(F.lit(0), F.lit(splits - 1)), train_from=F.lit(0), train_to=end, test_from=end + purge, test_to=end + purge + size - embargo)


def rolling(bars: DataFrame, train: int = 2000, test: int = 500, step: int = 250) -> DataFrame:
    """Training and test windows of fixed size that move on by `step` rows."""
    last = F.greatest(F.floor((F.col("__n") - train - test) / step), F.lit(0)).cast("int")
    start = F.col("fold") * step
    return _folds(bars, F.sequence(F.lit(0), last), train_from=start, train_to=start + train, test_from=start + train, test_to=start + train + test)


def time_series_cv(bars: DataFrame, splits: int = 5, test_share: float = 0.2) -> DataFrame:
    """Test windows of one size, the last of which ends with the history; training is all that lies before each."""
    test = F.floor(F.col("__n") * test_share)
    end = F.col("__n") - test - (splits - F.col("fold") - 1) * _share(test, splits)
    return _folds(bars, F.sequence(F.lit(0), F.lit(splits - 1)), train_from=F.lit(0), train_to=end, test_from=end, test_to=end + test)


def successive(bars: DataFrame, splits: int = 3) -> DataFrame:
    """The history's last parts in turn as tests, each after training on all before it."""
    size = _share(F.col("__n"), splits + 1)
    start = F.col("__n") - (splits - F.col("fold")) * size
    return _folds(bars, F.sequence(F.lit(0), F.lit(splits - 1)), train_from=F.lit(0), train_to=start, test_from=start, test_to=start + size)


def assign(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """A row of bars for each fold and part ("train" or "test") that it belongs to."""
    row = F.col("__row")
    joined = numbered(bars).join(F.broadcast(folds), "symbol")
    part = F.when((row >= F.col("train_from")) & (row < F.col("train_to")), "train").when((row >= F.col("test_from")) & (row < F.col("test_to")), "test")
    return joined.withColumn("part", part).where("part is not null").drop("__row", *BOUNDS)


def proportions(bars: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """bars with `part`: the first share of each symbol's rows train, the next validation, the rest test."""
    counts = bars.groupBy("symbol").agg(F.count("*").alias("__n"))
    part = F.when(F.col("__row") < F.floor(F.col("__n") * train), "train").when(F.col("__row") < F.floor(F.col("__n") * (train + validation)), "validation").otherwise("test")
    return numbered(bars).join(F.broadcast(counts), "symbol").withColumn("part", part).drop("__row", "__n")


def by_fold(parts: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Metrics of each symbol, fold and part, as any aggregates over its rows."""
    return parts.groupBy("symbol", "fold", "part").agg(F.count("*").alias("rows"), *[m.alias(n) for n, m in metrics.items()])


def uniform(seed: int, *keys: Column) -> Column:
    """A number within 0 and 1 that depends on the keys alone, so a task that runs again draws it again."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def noisy(bars: DataFrame, times: int, level: float, seed: int = 0) -> DataFrame:
    """`times` copies of bars (column `draw`) with normal noise on their prices, the same on all four of a bar."""
    key = [F.col("draw"), F.col("symbol"), F.unix_seconds(F.col("ts").cast("timestamp"))]
    drawn = bars.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(times))))
    normal = F.sqrt(-2 * F.log(uniform(seed, *key))) * F.cos(2 * pi * uniform(seed + 1, *key))
    drawn = drawn.withColumn("__f", 1 + level * normal)
    return drawn.withColumns({c: F.col(c) * F.col("__f") for c in ("open", "high", "low", "close")}).drop("__f")


def robustness(metrics: DataFrame, *names: str) -> DataFrame:
    """Over draws, for each metric: deviation, robustness 1 / (1 + deviation) and coefficient of variation (0 for a mean of 0)."""
    long = metrics.unpivot([], list(names), "metric", "value").where("value is not null")
    out = long.groupBy("metric").agg(F.stddev_samp("value").alias("std"), F.avg("value").alias("mean"), F.count("*").alias("draws")).where("draws > 1")
    return out.select("metric", "draws", "std", (1 / (1 + F.col("std"))).alias("robustness"), F.coalesce(safe(F.col("std"), F.abs(F.col("mean"))), F.lit(0.0)).alias("cv"))


def direction_accuracy(bars: DataFrame, label: str, horizon: int = 1) -> DataFrame:
    """Of labels 1 and -1 per symbol: the share whose sign the return over the next `horizon` bars has."""
    nexts = F.lead("close", horizon).over(ordered())
    df = bars.withColumn("__r", safe(nexts, F.col("close")) - 1).where((F.col(label) != 0) & F.col("__r").isNotNull())
    return df.groupBy("symbol").agg(F.count("*").alias("labels"), F.avg(F.when(F.signum("__r") == F.signum(F.col(label)), 1.0).otherwise(0.0)).alias("accuracy"))
