"""Joins in time: the last known row, rows of an interval, and what is missing on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, columns: list[str], tolerance: str | None = None, key: str | None = "symbol", ts: str = "ts", tie: str | None = None, block: str = "day") -> DataFrame:
    """left with the values of the last row of right at or before its time; null beyond the tolerance.

    Both sides are cut into calendar blocks, and each block of a key is led by the last right row before
    it, so that no task sorts a key's whole history. Right rows of equal time are ordered by tie. Without a
    key, the right rows are known to all of left; one row for each block is then ordered as a whole.
    """
    keys = [key] if key else []
    order = [ts] + ([tie] if tie else [])
    at = F.struct(*order)
    value = F.struct(F.col(ts).alias("__at"), *columns)
    right = right.where(F.col(ts).isNotNull()).withColumn("__block", F.date_trunc(block, ts))
    lasts = right.groupBy(*keys, "__block").agg(F.max_by(value, at).alias("__value"))
    # the last value before each block that either side has
    blocks = left.select(*keys, F.date_trunc(block, ts).alias("__block")).distinct()
    known = blocks.join(lasts, [*keys, "__block"], "full")
    earlier = F.last("__value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    carried = known.select(*keys, "__block", earlier.alias("__carried"))
    rows = left.withColumn("__block", F.date_trunc(block, ts)).withColumn("__left", F.struct(*left.columns))
    a = rows.select(*keys, "__block", F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("__tie"), "__left", F.lit(None).cast(lasts.schema["__value"].dataType).alias("__value"))
    b = right.select(*keys, "__block", F.col(ts).alias("__ts"), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("__tie"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), value.alias("__value"))
    so_far = Window.partitionBy(*keys, "__block").orderBy("__ts", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b).withColumn("__found", F.last("__value", ignorenulls=True).over(so_far)).where("__side = 1")
    joined = merged.join(carried, [*keys, "__block"], "left").withColumn("__found", F.coalesce("__found", "__carried"))
    fits: Column = F.col("__found").isNotNull()
    if tolerance:
        fits = fits & (F.col("__ts") <= F.col("__found.__at") + F.expr(f"interval {tolerance}"))
    return joined.select("__left.*", *[F.when(fits, F.col(f"__found.{c}")).alias(c) for c in columns])


def within(points: DataFrame, intervals: DataFrame, key: str = "symbol", ts: str = "ts", start: str = "start", stop: str = "stop", cell: str = "1 day") -> DataFrame:
    """Points joined with the intervals [start, stop) that hold them, by the cells of time that they touch."""
    size = f"interval {cell}"
    first, last = F.window(start, cell)["start"], F.window(F.col(stop), cell)["start"]
    begun = intervals.where(F.col(start) < F.col(stop)).withColumn("__first", first).withColumn("__last", last)
    cells = begun.withColumn("__cell", F.explode(F.sequence("__first", "__last", F.expr(size)))).drop("__first", "__last")
    placed = points.withColumn("__cell", F.window(ts, cell)["start"])
    joined = placed.join(cells.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & (placed["__cell"] == cells["__cell"]) & (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(stop)))
    return joined.drop("__cell", "__key")


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(actual, keys, "left_anti")


def difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each key of either side, with both values and their difference for each column."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, keys, "full").select(*keys, *[x for c in columns for x in (f"{c}_a", f"{c}_b", (F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{c}_diff"))])


def merge_timeframes(base: DataFrame, others: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """base with the columns of each other timeframe's last bar that has closed, as `<column>_<name>`.

    others: by name ('1h'), bars labelled by their start; a bar is known once it has ended.
    """
    from tidebars.operators.resample import duration

    for name, bars in others.items():
        known = bars.select("symbol", (F.col("ts") + F.expr(f"interval {duration(name)}")).alias("ts"), *[F.col(c).alias(f"{c}_{name}") for c in columns])
        base = asof(base, known, [f"{c}_{name}" for c in columns])
    return base
