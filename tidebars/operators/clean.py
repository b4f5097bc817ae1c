"""Rows before they are used: order-safe dedup, fills, scalars and groups of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebars.functions.frames import ordered, so_far


def dedupe(rows: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row of each key: the first or the last by order."""
    by = [F.col(c).desc() if keep == "last" else F.col(c).asc() for c in order]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")


def forward_fill(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in columns})


def fill_both(rows: DataFrame, *columns: str) -> DataFrame:
    """Forward, then backward for what leads (which looks ahead)."""
    later = ordered().rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(so_far()), F.first(c, ignorenulls=True).over(later)) for c in columns})


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column, otherwise: float = 0.0) -> Column:
    """x, or otherwise for infinities and NaN."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), otherwise).otherwise(x)


def parse_time(x: Column) -> Column:
    """A timestamp from ISO text or epoch seconds, milliseconds or microseconds, quoted or not; else null."""
    text = F.regexp_replace(F.trim(x.cast("string")), "[\"']", "")
    number = F.when(text.rlike(r"^\d{10,16}$"), text.try_cast("long"))
    size = F.length(text)
    epoch = F.when(size <= 11, F.timestamp_seconds(number)).when(size <= 14, F.timestamp_millis(number)).otherwise(F.timestamp_micros(number))
    return F.coalesce(epoch, F.try_to_timestamp(F.when(number.isNull(), text)))


def shift_zone(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def columns_of(rows: DataFrame, pattern: str) -> list[str]:
    """The columns whose whole name matches pattern: a group of features by prefix, for example."""
    return [c for c in rows.columns if re.fullmatch(pattern, c)]


def with_suffix(rows: DataFrame, suffix: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}_{suffix}" for c in rows.columns if c not in keys})


def weighted_mean(parts: dict[str, float], present: list[str]) -> Column:
    """sum(weight * column) over the weights' sum; missing columns are skipped, nulls count as 0, all null is null."""
    use = {c: w for c, w in parts.items() if c in present}
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in use.items()), F.lit(0.0))
    return F.when(F.coalesce(*[F.col(c) for c in use]).isNotNull(), total / sum(use.values()))


def sessions(ts: Column) -> dict[str, Column]:
    """Flags of the three market sessions, which overlap, by hour."""
    hour = F.hour(ts)
    return {"asian": (hour >= 0) & (hour < 8), "london": (hour >= 8) & (hour < 16), "new_york": (hour >= 13) & (hour < 21)}


def in_hours(ts: Column, start: int, end: int) -> Column:
    """Hours from start to before end, which doesn't wrap past midnight."""
    return (F.hour(ts) >= start) & (F.hour(ts) < end)
