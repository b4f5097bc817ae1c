"""Runs of equal labels, and states that carry on until an event ends them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebars.functions.frames import before, carry, ordered, so_far


def with_runs(rows: DataFrame, label: str, name: str = "run") -> DataFrame:
    """rows with a number that grows by 1 where label changes."""
    begins = F.when(before(label).eqNullSafe(F.col(label)) & (F.row_number().over(ordered()) > 1), 0).otherwise(1)
    return rows.withColumn("__begins", begins).withColumn(name, F.sum("__begins").over(so_far())).drop("__begins")


def runs(rows: DataFrame, label: str) -> DataFrame:
    """A row for each run: its label, bounds and length."""
    return with_runs(rows, label).groupBy("symbol", "run").agg(F.first(label).alias(label), F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("length"))


def persist(rows: DataFrame, label: str, least: int, name: str = "persistent") -> DataFrame:
    """Runs shorter than least take the label of the run after them, or before if they are last."""
    every = runs(rows, label)
    w = Window.partitionBy("symbol").orderBy("run")
    kept = F.when(F.col("length") >= least, F.col(label)).otherwise(F.coalesce(F.lead(label).over(w), F.lag(label).over(w), F.col(label)))
    return with_runs(rows, label).join(every.select("symbol", "run", kept.alias(name)), ["symbol", "run"]).drop("run")


def hysteresis(x: Column, enter: float, leave: float) -> Column:
    """1 from where x reaches enter until it falls to leave (below enter), else 0."""
    return F.coalesce(carry(F.when(x >= enter, 1).when(x <= leave, 0)), F.lit(0))


def alternating(long: Column, short: Column) -> Column:
    """1 or -1 where a signal flips the last one, else 0. A row with both signals counts as long."""
    now = F.when(long, 1).when(short, -1)
    last = F.last(now, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    return F.when(now.isNotNull() & ~now.eqNullSafe(last), now).otherwise(0)


def streak(rows: DataFrame, test: Column, name: str) -> DataFrame:
    """rows with the number of rows up to this one for which test has held without a break."""
    held = rows.withColumn("__held", F.coalesce(test, F.lit(False)))
    numbered = with_runs(held, "__held", "__run")
    within = Window.partitionBy("symbol", "__run").orderBy("ts")
    return numbered.withColumn(name, F.when(F.col("__held"), F.row_number().over(within)).otherwise(0)).drop("__held", "__run")


def crosses(a: Column | str, b: Column | str) -> Column:
    """1 where a crosses over b, -1 where it crosses under, else 0."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    was_x, was_y = before(x), before(y)
    return F.when((x > y) & (was_x <= was_y), 1).when((x < y) & (was_x >= was_y), -1).otherwise(0)


def transitions(rows: DataFrame, label: str) -> DataFrame:
    """How often each label follows each, and its share of all and of its first label."""
    pairs = rows.select("symbol", before(label).alias("was"), F.col(label).alias("now")).where("was is not null and now is not null")
    counts = pairs.groupBy("was", "now").count()
    return counts.select("*", (F.col("count") / F.sum("count").over(Window.partitionBy("was"))).alias("of_was"), (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("of_all"))
