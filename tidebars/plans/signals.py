"""Signals from indicators: votes, combinations, expiry and entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.runs import streak


def votes(bars: DataFrame) -> DataFrame:
    """RSI, band and trend votes in -1, 0, 1. bars: rsi, bb_percent, sma_20."""
    return bars.withColumns({
        "vote_rsi": F.when(F.col("rsi") < 30, 1).when(F.col("rsi") > 70, -1).otherwise(0),
        "vote_band": F.when(F.col("bb_percent") < 0, 1).when(F.col("bb_percent") > 1, -1).otherwise(0),
        "vote_trend": F.when(F.col("close") > F.col("sma_20"), 1).when(F.col("close") < F.col("sma_20"), -1).otherwise(0),
    })


def score(weights: dict[str, float]) -> Column:
    """sum(weight * vote) / sum(weight), within -1 and 1."""
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()])
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / sum(weights.values())))


def confirmed(leading: Column, confirmations: list[Column], least: float = 0.5) -> Column:
    """The leading signal where the mean of the confirmations goes with it by more than least, else 0."""
    mean = reduce(lambda a, b: a + b, confirmations) / len(confirmations)
    return F.when((leading > 0) & (mean > least), 1).when((leading < 0) & (mean < -least), -1).otherwise(0)


def all_of(leading: Column, filters: dict[str, Column], enabled: set[str]) -> Column:
    """True where leading and every enabled filter hold."""
    return reduce(lambda a, b: a & b, [f for name, f in filters.items() if name in enabled], leading)


def expiring(bars: DataFrame, test: Column, most: int, name: str) -> DataFrame:
    """bars with name: whether test holds and has held for at most so many rows."""
    return streak(bars, test, "__streak").withColumn(name, (F.col("__streak") >= 1) & (F.col("__streak") <= most)).drop("__streak")


def entries(scores: Column, enter_long: float, enter_short: float, leave: float) -> Column:
    """1 or -1 from the thresholds, 0 within `leave` of nothing, else null (no change)."""
    return F.when(scores >= enter_long, 1).when(scores <= -enter_short, -1).when(F.abs(scores) <= leave, 0)
