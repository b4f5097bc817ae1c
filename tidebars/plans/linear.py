"""Least squares with many regressors by sums of products, polynomials beyond the data, and trends with seasons.

What is summed are centred and scaled columns, in one pass for their means and one for their products; the
systems of equations, as many as there are symbols and as large as there are regressors, are solved in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.plans.graph import settle

DAY, WEEK = 86_400.0, 604_800.0


def numbered(df: DataFrame, key: str = "symbol", time: str = "ts", name: str = "row") -> DataFrame:
    """df with the number of each row of a symbol in time order, from 0; by counts of days, never by one sort of a symbol."""
    counted = df.withColumn("__day", F.to_date(time))
    days = counted.groupBy(key, "__day").count()
    starts = days.withColumn("__first", F.sum("count").over(Window.partitionBy(key).orderBy("__day")) - F.col("count")).drop("count")
    return counted.join(starts, [key, "__day"]).withColumn(name, F.col("__first") + F.row_number().over(Window.partitionBy(key, "__day").orderBy(time)) - 1).drop("__day", "__first")


def _added(rows: DataFrame, of, kind: str) -> DataFrame:
    """(key, value): of(matrix of rows, first row of extras) of each symbol's rows in a batch, added up elementwise, first in the task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            keys, z = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            matrix = z.flatten().to_numpy(zero_copy_only=False).reshape(len(z), -1)
            for key in set(keys):
                own = np.flatnonzero(keys == key)
                found = of(matrix[own], [batch.column(c)[int(own[0])].as_py() for c in range(2, batch.num_columns)])
                sums[key] = sums[key] + found if key in sums else found
        for key, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * found.size), pa.array(np.arange(found.size, dtype=np.int32)), pa.array(found.ravel())], ["key", "at", "value"])

    parts = rows.mapInArrow(add, f"key {kind}, at int, value double").groupBy("key", "at").agg(F.sum("value").alias("value"))
    return parts.groupBy("key").agg(F.transform(F.array_sort(F.array_agg(F.struct("at", "value"))), lambda v: v["value"]).alias("value"))


def least_squares(table: DataFrame, columns: dict[str, Column], target: Column, ridge: dict[str, float] | None = None, key: str = "symbol") -> DataFrame:
    """A row a symbol: intercept, coefficients (in the order of columns), n and r2 of target on columns.

    ridge: added to the mean square of the scaled column with that name. Rows with a null among columns or target take no
    part; a column without spread, or one that others make up, gets what the least norm gives it.
    """
    names, ridge, kind = list(columns), ridge or {}, dict(table.dtypes)[key]
    # one array and not a column each: the optimizer's constraints grow with the square of such columns, and worse
    rows = table.select(F.col(key).alias("key"), F.array(*[c.cast("double") for c in columns.values()], target.cast("double")).alias("z"))
    rows = rows.where(F.col("key").isNotNull() & ~F.exists("z", lambda v: v.isNull() | F.isnan(v)))
    first = _added(rows, lambda m, _: np.concatenate([[float(len(m))], m.sum(axis=0), (m * m).sum(axis=0)]), kind)
    means = settle(first.select("key", F.get("value", F.lit(0)).alias("n"), F.transform(F.slice("value", 2, len(names) + 1), lambda v: v / F.get("value", F.lit(0))).alias("centre")), "means")

    def spread(m: np.ndarray, extras: list) -> np.ndarray:
        return ((m - np.array(extras[0])) ** 2).sum(axis=0)

    widths = _added(rows.join(means.select("key", "centre"), "key"), spread, kind)
    scales = settle(means.join(widths, "key").select("key", "n", "centre", F.transform("value", lambda v: F.sqrt(v / F.col("n"))).alias("scales")), "scales")

    def products(m: np.ndarray, extras: list) -> np.ndarray:
        scaled = (m - np.array(extras[0])) / np.where(np.array(extras[1]) > 0, extras[1], 1.0)
        return scaled.T @ scaled

    sums = _added(rows.join(scales.select("key", "centre", "scales"), "key"), products, kind)
    extra = np.array([ridge.get(n, 0.0) for n in names])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                p, n, centre, scale = len(names), r.n, np.array(r.centre), np.array(r.scales)
                g = np.array(r.value).reshape(p + 1, p + 1) / n
                # a column whose spread is the rounding of its mean has none
                flat = scale[:p] <= 1e-12 * np.abs(centre[:p])
                g[:p][flat], g[:, :p][:, flat] = 0.0, 0.0
                b = np.linalg.pinv(g[:p, :p] + np.diag(extra), rcond=1e-13, hermitian=True) @ g[:p, p] if p else np.zeros(0)
                b[flat] = 0.0
                left = g[p, p] - 2 * b @ g[:p, p] + b @ g[:p, :p] @ b
                of = b * (scale[p] if scale[p] > 0 else 1.0) / np.where(scale[:p] > 0, scale[:p], 1.0)
                out.append((r.key, float(centre[p] - of @ centre[:p]), of.tolist(), int(n), float(1 - left / g[p, p]) if g[p, p] > 0 else None))
            yield pd.DataFrame(out, columns=["key", "intercept", "coefficients", "n", "r2"])

    return scales.join(sums, "key").mapInPandas(solve, f"key {kind}, intercept double, coefficients array<double>, n long, r2 double").withColumnRenamed("key", key)


def _value(columns: list[Column]) -> Column:
    return sum((F.get("coefficients", F.lit(k)) * c for k, c in enumerate(columns)), F.col("intercept"))


def polynomial_beyond(bars: DataFrame, x: str, degree: int, extra: int) -> DataFrame:
    """symbol, row, fitted, beyond: the least-squares polynomial through each symbol's whole history of x, and `extra` rows beyond it.

    Powers are of the row scaled into -1 to 1, so that they stay well apart.
    """
    counted = numbered(bars.select("symbol", "ts", x))
    sizes = counted.groupBy("symbol").agg(F.count("*").alias("__all"))
    place = (2 * F.col("row") - (F.col("__all") - 1)) / F.greatest(F.col("__all") - 1, F.lit(1))
    powers = [F.pow(place, F.lit(d)) for d in range(1, degree + 1)]
    fit = least_squares(counted.join(sizes, "symbol"), {f"p{d}": p for d, p in enumerate(powers, 1)}, F.col(x))
    each = sizes.join(fit, "symbol").withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__all") + extra - 1)))
    return each.select("symbol", "row", _value(powers).alias("fitted"), (F.col("row") >= F.col("__all")).alias("beyond"))


def _seasonal(seconds: Column, period: float, order: int) -> list[Column]:
    angle = [seconds * (2 * np.pi * k / period) for k in range(1, order + 1)]
    return [f(a) for a in angle for f in (F.sin, F.cos)]


def decompose(bars: DataFrame, x: str, horizon: int, step_seconds: int, changes: int = 10, daily: int = 4, weekly: int = 3, stiffness: float = 1e-4) -> DataFrame:
    """symbol, ts, trend, daily, weekly, fitted, beyond: an additive model of each symbol's x, and `horizon` steps after its last bar.

    The trend is a line whose slope may change at `changes` times, evenly set over the first 80 % of the history; its
    changes are held back by ridge. The seasons are Fourier sums over a day and a week, which need no whole number of bars.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = bars.select("symbol", "ts", F.col(x).alias("__x"), seconds.alias("__t"))
    spans = rows.where("__x is not null").groupBy("symbol").agg(F.min("__t").alias("__from"), F.max("__t").alias("__to"), F.max("ts").alias("__last"))
    at = (F.col("__t") - F.col("__from")) / F.greatest(F.col("__to") - F.col("__from"), F.lit(1.0))
    trend = [at, *[F.greatest(at - 0.8 * (j + 1) / (changes + 1), F.lit(0.0)) for j in range(changes)]]
    by_day, by_week = _seasonal(F.col("__t"), DAY, daily), _seasonal(F.col("__t"), WEEK, weekly)
    every = [*trend, *by_day, *by_week]
    fit = least_squares(rows.join(spans, "symbol"), {f"c{k}": c for k, c in enumerate(every)}, F.col("__x"), {f"c{k}": stiffness for k in range(1, changes + 1)})
    known = rows.join(spans, "symbol").select("symbol", "ts", "__t", "__from", "__to", F.lit(False).alias("beyond"))
    steps = spans.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))) if horizon else spans.limit(0).withColumn("__k", F.lit(1))
    later = steps.select("symbol", (F.col("__last") + F.make_dt_interval(secs=F.col("__k") * step_seconds)).alias("ts"), (F.col("__to") + F.col("__k") * step_seconds).alias("__t"), "__from", "__to", F.lit(True).alias("beyond"))
    part = lambda first, columns: sum((F.get("coefficients", F.lit(first + k)) * c for k, c in enumerate(columns)), F.lit(0.0))
    out = known.unionByName(later).join(fit, "symbol").select(
        "symbol", "ts", "beyond", (F.col("intercept") + part(0, trend)).alias("trend"), part(len(trend), by_day).alias("daily"), part(len(trend) + len(by_day), by_week).alias("weekly")
    )
    return out.withColumn("fitted", F.col("trend") + F.col("daily") + F.col("weekly"))
