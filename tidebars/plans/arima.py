"""Autoregressive moving-average models of differenced series, by aggregates over lagged rows.

Autocovariances are sums over pairs of rows, taken by blocks of a symbol; Levinson's recursion turns
those of a symbol, a row of max lag + 1 numbers, into coefficients. With a moving average, a long
autoregression gives the shocks, and a regression on lagged values and lagged shocks the coefficients
(Hannan and Rissanen). Forecasts are iterated from each symbol's last rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.frames import before, blocked
from tidebars.plans.graph import settle
from tidebars.plans.linear import least_squares, numbered


def differenced(bars: DataFrame, x: str, times: int = 0, season: int = 0, name: str = "w") -> DataFrame:
    """bars with x less its value `season` rows before (if season), then `times` times less the value a row before; null on the first rows."""

    def build(df: DataFrame) -> DataFrame:
        df = df.withColumn(name, F.col(x).cast("double"))
        if season:
            df = df.withColumn(name, F.col(name) - before(name, season))
        for _ in range(times):
            df = df.withColumn(name, F.col(name) - before(name))
        return df

    return blocked(bars, build, times + season) if times + season else build(bars)


def _lagged(series: DataFrame, columns: dict[str, int]) -> DataFrame:
    """series (symbol, ts and more) with name_1 .. name_k, the values k rows before; null before the first row."""

    def build(df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}_{k}": before(c, k) for c, most in columns.items() for k in range(1, most + 1)})

    return blocked(series, build, max(columns.values())) if any(columns.values()) else series


def autocovariances(series: DataFrame, x: str, most: int) -> DataFrame:
    """symbol, mean, n and gamma: the autocovariances of lags 0 to most, all divided by n. Rows with a null x don't count as rows."""
    rows = series.where(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).alias("w"))
    means = rows.groupBy("symbol").agg(F.avg("w").alias("mean"), F.count("*").alias("n"))
    away = rows.join(means, "symbol").select("symbol", "ts", (F.col("w") - F.col("mean")).alias("w"))
    sums = _lagged(away, {"w": most}).groupBy("symbol").agg(F.array(F.sum(F.col("w") * F.col("w")), *[F.coalesce(F.sum(F.col("w") * F.col(f"w_{k}")), F.lit(0.0)) for k in range(1, most + 1)]).alias("s"))
    return means.join(sums, "symbol").select("symbol", "mean", "n", F.transform("s", lambda v: v / F.col("n")).alias("gamma"))


def levinson(gamma: np.ndarray) -> tuple[np.ndarray, float]:
    """The coefficients of the autoregression of order len(gamma) - 1, and the variance of its shocks."""
    phi, variance = np.zeros(0), float(gamma[0])
    for k in range(1, len(gamma)):
        if variance <= 1e-12 * max(float(gamma[0]), 1e-300):
            return np.concatenate([phi, np.zeros(len(gamma) - k)]), max(variance, 0.0)
        last = (gamma[k] - phi @ gamma[k - 1 : 0 : -1]) / variance if k > 1 else gamma[1] / variance
        phi = np.concatenate([phi - last * phi[::-1], [last]])
        variance *= 1 - last * last
    return phi, variance


def autoregression(series: DataFrame, x: str, order: int) -> DataFrame:
    """symbol, mean, phi, theta (empty) and variance by Yule and Walker's equations."""

    def solve(frames):
        for f in frames:
            found = [levinson(np.asarray(g, float)) for g in f["gamma"]]
            yield f.assign(phi=[p.tolist() for p, _ in found], theta=[[] for _ in found], variance=[v for _, v in found])[["symbol", "mean", "phi", "theta", "variance", "n"]]

    return autocovariances(series, x, order).mapInPandas(solve, "symbol string, mean double, phi array<double>, theta array<double>, variance double, n long")


def _shocks(series: DataFrame, x: str, long_order: int) -> DataFrame:
    """symbol, ts, w (x less its mean) and e, the shocks under a long autoregression; null on the first rows."""
    model = autoregression(series, x, long_order)
    rows = series.where(F.col(x).isNotNull()).join(model.select("symbol", "mean", "phi"), "symbol").select("symbol", "ts", (F.col(x) - F.col("mean")).alias("w"), "phi")
    late = _lagged(rows, {"w": long_order})
    return late.select("symbol", "ts", "w", (F.col("w") - sum((F.get("phi", F.lit(k - 1)) * F.col(f"w_{k}") for k in range(1, long_order + 1)), F.lit(0.0))).alias("e"))


def fit(series: DataFrame, x: str, p: int, q: int = 0, long_order: int | None = None) -> DataFrame:
    """symbol, mean, phi, theta, variance, n of an ARMA(p, q) of x; rows with a null x don't count as rows."""
    if not q:
        return autoregression(series, x, p)
    shocks = settle(_shocks(series, x, long_order or max(10, 2 * (p + q))), "shocks")
    late = _lagged(shocks, {"w": p, "e": q})
    names = [*[f"w_{k}" for k in range(1, p + 1)], *[f"e_{k}" for k in range(1, q + 1)]]
    found = least_squares(late, {c: F.col(c) for c in names}, F.col("w"))
    means = series.where(F.col(x).isNotNull()).groupBy("symbol").agg(F.avg(x).alias("mean"), F.var_pop(x).alias("__v"))
    return found.join(means, "symbol").select("symbol", "mean", F.slice("coefficients", 1, p).alias("phi"), F.slice("coefficients", p + 1, q).alias("theta"), (F.col("__v") * (1 - F.col("r2"))).alias("variance"), "n")


def forecast(bars: DataFrame, x: str, order: tuple[int, int, int], steps: int, season: int = 0, long_order: int | None = None) -> DataFrame:
    """symbol, step (from 1) and forecast of x by ARIMA(p, d, q), with one seasonal difference if season; of order d and q in the usual sense.

    A symbol with fewer rows than the lags need gives none.
    """
    p, d, q = order
    series = settle(differenced(bars.where(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).alias("x")), "x", d, season), "differences")
    model = fit(series, "w", p, q, long_order)
    need = d + season + max(p, q, 1) + 1
    shocks = _shocks(series, "w", long_order or max(10, 2 * (p + q))).select("symbol", "ts", "e") if q else series.select("symbol", "ts", F.lit(0.0).alias("e"))
    last = numbered(series).join(series.groupBy("symbol").agg(F.count("*").alias("rows")), "symbol").where(F.col("row") >= F.col("rows") - need)
    tails = last.join(shocks, ["symbol", "ts"], "left").groupBy("symbol").agg(F.array_sort(F.array_agg(F.struct("row", "x", "w", "e"))).alias("tail"))

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                xs, ws, es = ([t[c] if t[c] is not None else np.nan for t in r.tail] for c in ("x", "w", "e"))
                ws, es = [w - r.mean for w in ws], [0.0 if np.isnan(e) else e for e in es]
                if len(xs) < need or np.isnan(ws[-max(p, q, 1) :]).any():
                    continue
                for step in range(1, steps + 1):
                    w = sum(c * ws[-k - 1] for k, c in enumerate(r.phi)) + sum(c * es[-k - 1] for k, c in enumerate(r.theta))
                    ws.append(w), es.append(0.0)
                    # undo the differences: x is w and what the earlier x make of it
                    value = w + r.mean - sum(c * xs[-k] for k, c in enumerate(undo) if k)
                    xs.append(value)
                    out.append((r.symbol, step, float(value)))
            yield pd.DataFrame(out, columns=["symbol", "step", "forecast"])

    undo = np.array([1.0])
    for _ in range(d):
        undo = np.convolve(undo, [1.0, -1.0])
    if season:
        undo = np.convolve(undo, [1.0, *[0.0] * (season - 1), -1.0])
    return tails.join(model, "symbol").mapInPandas(run, "symbol string, step int, forecast double")
