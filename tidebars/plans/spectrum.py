"""The discrete Fourier transform of a symbol's whole history over many tasks, and its strongest harmonics beyond the data.

A transform of any length becomes a convolution with a chirp, of a length that is a power of two. Such a
transform runs in two stages: rows that are equal by residue are transformed together, turned by their
twiddle factors, shuffled, and transformed across the residues. A task holds whole residues, about
TASK_ROWS rows of them, never a symbol.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.plans.graph import settle
from tidebars.plans.linear import numbered

TASK_ROWS = 65536
_TABLE = "symbol string, n long, at long, re double, im double"


def _lengths(size: int) -> tuple[int, int]:
    bits = int(log2(size))
    return 1 << bits // 2, 1 << (bits - bits // 2)


def _sizes(n: pd.Series) -> int:
    """The power of two that a circular convolution with the chirp of n rows needs."""
    return 1 << max(2, ceil(log2(2 * int(n.iloc[0]) - 1 if int(n.iloc[0]) > 1 else 2)))


def _stage(rows: pd.DataFrame, first: bool, sign: int) -> pd.DataFrame:
    """Transforms the residues of one group. First: rows at = residue + second * k by residue, then turned; else by the index that the first stage gave."""
    size = _sizes(rows["n"])
    one, two = _lengths(size)  # k runs over one, residues over two
    at = rows["at"].to_numpy()
    z = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
    line, place = (at % two, at // two) if first else (at // two, at % two)
    lines, own = np.unique(line, return_inverse=True)
    grid = np.zeros((len(lines), one if first else two), complex)
    grid[own, place] = z
    grid = np.fft.fft(grid, axis=1) if sign < 0 else np.fft.ifft(grid, axis=1)
    if first:  # to (frequency k1, residue): turned, and laid out by frequency
        k1 = np.arange(one)
        grid = grid * np.exp(sign * 2j * np.pi * (lines[:, None] * k1 % size) / size)
        out = k1[None, :] * two + lines[:, None]
    else:  # frequency k1 + one * k2
        out = lines[:, None] + one * np.arange(two)[None, :]
    flat = grid.ravel()
    return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "n": rows["n"].iloc[0], "at": out.ravel(), "re": flat.real, "im": flat.imag})


def _run_stage(first: bool, sign: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _stage(rows, first, sign)

    return run


def _transform(table: DataFrame, sign: int) -> DataFrame:
    """Of each symbol: the transform (sign -1) or its inverse (1) of length `size`, a power of two that follows from n; rows not there are 0."""
    bits = F.ceil(F.log2(F.greatest(2 * F.col("n") - 1, F.lit(4)))).cast("int")
    two = F.expr("shiftleft(1L, cast(__bits - __bits div 2 as int))")
    for first in (True, False):
        line = F.col("at") % F.col("__two") if first else F.floor(F.col("at") / F.col("__two"))
        length = F.expr("shiftleft(1L, cast(__bits div 2 as int))") if first else F.col("__two")
        dealt = table.withColumn("__bits", bits).withColumn("__two", two).withColumn("__task", F.floor(line * length / TASK_ROWS))
        table = dealt.groupBy("symbol", "__task").applyInPandas(_run_stage(first, sign), _TABLE)
    return table


def fourier(series: DataFrame, x: str) -> DataFrame:
    """symbol, n, at, re, im: the transform of each symbol's x in time order, of its own length n, for at from 0 to n - 1; rows with a null x are left out."""
    rows = numbered(series.where(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).cast("double").alias("x"))).select("symbol", "row", "x")
    sizes = settle(rows.groupBy("symbol").agg(F.count("*").alias("n")), "sizes")
    # k * k by whole numbers, so that the chirp's angle is exact
    angle = lambda k: F.lit(np.pi) * ((k * k) % (2 * F.col("n"))) / F.col("n")
    at = F.col("row")
    a = rows.join(sizes, "symbol").select("symbol", "n", at.alias("at"), (F.col("x") * F.cos(angle(at))).alias("re"), (-F.col("x") * F.sin(angle(at))).alias("im"))
    size = F.expr("shiftleft(1L, cast(ceil(log2(greatest(2 * n - 1, 4))) as int))")
    k = F.col("k")
    chirp = sizes.withColumn("size", size).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    places = F.array_distinct(F.array(k, (F.col("size") - k) % F.col("size")))
    b = chirp.select("symbol", "n", F.explode(places).alias("at"), F.cos(angle(k)).alias("re"), F.sin(angle(k)).alias("im"))
    left, right = _transform(a, -1), _transform(b, -1).select("symbol", "at", F.col("re").alias("c"), F.col("im").alias("d"))
    product = left.join(right, ["symbol", "at"]).select("symbol", "n", "at", (F.col("re") * F.col("c") - F.col("im") * F.col("d")).alias("re"), (F.col("re") * F.col("d") + F.col("im") * F.col("c")).alias("im"))
    turned = _transform(product, 1).where(F.col("at") < F.col("n"))
    c, s = F.cos(angle(F.col("at"))), F.sin(angle(F.col("at")))
    return turned.select("symbol", "n", "at", (F.col("re") * c + F.col("im") * s).alias("re"), (F.col("im") * c - F.col("re") * s).alias("im"))


def harmonics_beyond(bars: DataFrame, x: str, harmonics: int, extra: int) -> DataFrame:
    """symbol, row, fitted, beyond: the least-squares slope of each symbol's x and its strongest 1 + 2 * harmonics frequencies, `extra` rows beyond the data.

    Frequencies are ranked by size to nine digits, the higher index first, since those that mirror each other are equal.
    """
    rows = numbered(bars.where(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).cast("double").alias("x")))
    slope = rows.groupBy("symbol").agg(F.coalesce(F.regr_slope("x", "row"), F.lit(0.0)).alias("slope"))
    rest = settle(rows.join(slope, "symbol").select("symbol", "ts", (F.col("x") - F.col("slope") * F.col("row")).alias("x"), "slope"), "without-slope")
    found = fourier(rest, "x")
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    top = Window.partitionBy("symbol").orderBy(F.desc(F.round(size / F.col("n"), 9)), F.desc("at"))
    kept = found.withColumn("__k", F.row_number().over(top)).where(F.col("__k") <= 1 + 2 * harmonics)
    waves = kept.groupBy("symbol", "n").agg(F.array_agg(F.struct((size / F.col("n")).alias("size"), F.atan2("im", "re").alias("angle"), F.col("at").alias("at"))).alias("waves"))
    each = waves.join(slope, "symbol").withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + extra - 1)))
    wave = F.aggregate("waves", F.lit(0.0), lambda total, w: total + w["size"] * F.cos(2 * np.pi * ((w["at"] * F.col("row")) % F.col("n")) / F.col("n") + w["angle"]))
    return each.select("symbol", "row", (wave + F.col("slope") * F.col("row")).alias("fitted"), (F.col("row") >= F.col("n")).alias("beyond"))
