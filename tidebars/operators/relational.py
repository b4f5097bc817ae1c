"""Joins, sets and ranks of whole tables that the other operators don't have: thin forms with defined ties and nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def semi(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur among others; null keys never do."""
    return rows.join(others.select(*keys), list(keys), "left_semi").select(rows.columns)


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows of all tables by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by order, which should end in a key so that ties are settled."""
    return rows.orderBy(*order).limit(n)


def best(rows: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """For each group the row of the highest score, of equal ones that with the least tie."""
    rest = [c for c in rows.columns if c not in by]
    found = rows.where(F.col(score).isNotNull()).groupBy(*by).agg(F.min(F.struct((-F.col(score)).alias("__s"), F.col(tie).alias("__t"), *rest)).alias("__b"))
    return found.select(*by, *[F.col(f"__b.{c}").alias(c) for c in rest])


def ends(rows: DataFrame, n: int, key: str = "symbol", time: str = "ts") -> DataFrame:
    """The first and the last n rows of each key, with `end`: head or tail (a row can be both)."""
    w = Window.partitionBy(key)
    numbered = rows.withColumns({"__first": F.row_number().over(w.orderBy(time)), "__last": F.row_number().over(w.orderBy(F.col(time).desc()))})
    marks = F.array_compact(F.array(F.when(F.col("__first") <= n, F.lit("head")), F.when(F.col("__last") <= n, F.lit("tail"))))
    return numbered.withColumn("end", F.explode(marks)).drop("__first", "__last")


def sample(rows: DataFrame, share: float, *key: str, seed: int = 0) -> DataFrame:
    """About so large a share of the rows by a hash of their key: the same rows whatever the partitions."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 20)) < int(share * (1 << 20)))


def in_regimes(rows: DataFrame, labels: DataFrame, label: str, *wanted: object) -> DataFrame:
    """The rows whose label at that time is one of those wanted."""
    return semi(rows, labels.where(F.col(label).isin(*wanted)), "symbol", "ts")


def side_by_side(left: DataFrame, right: DataFrame, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Row k of each key of left beside row k of right by time; the shorter one ends both. Columns of right get the suffix _2."""
    w = Window.partitionBy(key).orderBy(time)
    other = right.select(key, F.row_number().over(w).alias("__row"), *[F.col(c).alias(f"{c}_2") for c in right.columns if c != key])
    return left.withColumn("__row", F.row_number().over(w)).join(other, [key, "__row"]).drop("__row")


def common_times(*tables: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """The keys that all tables have."""
    return reduce(DataFrame.intersect, [t.select(*keys) for t in tables])


def ordinal_rank(rows: DataFrame, label: str, value: str, name: str = "rank") -> DataFrame:
    """For each label its mean value and its place among the labels by it (from 1; ties by label).

    A row for each label, of which there are few, is what the ranking sorts.
    """
    means = rows.groupBy(label).agg(F.avg(value).alias(f"mean_{value}"))
    pairs = means.join(F.broadcast(means.select(F.col(label).alias("__l"), F.col(f"mean_{value}").alias("__m"))), (F.col("__m") < F.col(f"mean_{value}")) | ((F.col("__m") == F.col(f"mean_{value}")) & (F.col("__l") < F.col(label))), "left")
    return pairs.groupBy(label, f"mean_{value}").agg((F.count("__l") + 1).alias(name))


def with_bars(trades: DataFrame, bars: DataFrame, time: str, timeframe: str, *columns: str) -> DataFrame:
    """trades with columns of the bar that each trade's time falls in, as entry_<column>; null without one."""
    start = F.window(F.col(time).cast("timestamp_ntz"), timeframe)["start"].cast("timestamp_ntz")
    chosen = bars.select("symbol", F.col("ts").alias("__bar"), *[F.col(c).alias(f"entry_{c}") for c in columns])
    return trades.withColumn("__bar", start).join(chosen, ["symbol", "__bar"], "left").drop("__bar")


def combine(bars: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """bars with the columns of every other table at the same symbol and time, named <table>_<column>; absent numbers are 0."""
    out = bars
    for name, table in others.items():
        values = [c for c in table.columns if c not in ("symbol", "ts")]
        out = out.join(table.select("symbol", "ts", *[F.col(c).alias(f"{name}_{c}") for c in values]), ["symbol", "ts"], "left")
        out = out.fillna(0, [f"{name}_{c}" for c in values])
    return out


def cut(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval (edges[k], edges[k + 1]] that x lies in, null outside."""
    test = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        test = F.when((x > low) & (x <= high), label).otherwise(test)
    return test


def mapped(x: Column, values: dict) -> Column:
    """The value of a dictionary at x, null for other keys."""
    pairs = [F.lit(part) for pair in values.items() for part in pair]
    return F.element_at(F.create_map(*pairs), x)


def json_list(x: Column, kind: str = "double") -> Column:
    """A cell that spells a JSON list, as an array; null if it isn't one."""
    return F.from_json(x, f"array<{kind}>")
