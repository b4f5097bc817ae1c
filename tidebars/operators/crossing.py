"""The first later bar that reaches a level, for a level at every bar, without a range join.

Bars are cut into blocks. A block answers what it can of its own levels by maxima over growing runs of
rows; for the rest, each block knows which later blocks set new maxima (the chain), so that a level goes
straight to the first block that reaches it, which finds the bar. A level meets two blocks, however far
away its bar is. A block that many levels go to is copied, so that one spike is no single task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.frames import before, blocked, ordered
from tidebars.plans.graph import settle
from tidebars.plans.linear import numbered

BLOCK_ROWS = 32768
#: Levels that one copy of a block answers.
CROWD = 100_000


def first_reaching(values: np.ndarray, start: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first place from start on with a value of at least the level; len(values) if there is none. NaN reaches nothing."""
    values = np.where(np.isnan(values), -np.inf, values)
    runs = [values]
    while 2 ** len(runs) <= len(values):
        step = 2 ** (len(runs) - 1)
        runs.append(np.maximum(runs[-1][:-step], runs[-1][step:]))
    at = start.astype(np.int64).copy()
    for k in range(len(runs) - 1, -1, -1):
        fits = at + 2**k <= len(values)
        low = np.zeros(len(at), bool)
        low[fits] = runs[k][at[fits]] < levels[fits]
        at[low] += 2**k
    return at


def next_reaching(bars: DataFrame, level: str, value: str, upward: bool = True, name: str = "reached", block_rows: int | None = None) -> DataFrame:
    """bars with `name`, the ts of the first later bar of the symbol whose value is at least (upward) or at most the level; null without a level or such a bar."""
    sign = 1.0 if upward else -1.0
    size = block_rows or BLOCK_ROWS
    rows = numbered(bars, name="__row").withColumn("__block", F.floor(F.col("__row") / size))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), sign * F.col(c).cast("double"))
    rows = settle(rows.withColumn("__v", number(value)).withColumn("__l", number(level)), "bars")
    slim = rows.select("symbol", "ts", "__row", "__block", "__v", "__l")
    time = bars.schema["ts"].dataType.simpleString()

    def chains(table: pd.DataFrame) -> pd.DataFrame:
        """Of each block the later ones that set new maxima: from the next block on, always to the next greater."""
        table = table.sort_values("__block")
        top, number = table["m"].to_numpy(float), table["__block"].to_numpy()
        top = np.where(np.isnan(top), -np.inf, top)
        greater, stack = np.full(len(top), -1), []
        for j in range(len(top) - 1, -1, -1):
            while stack and top[stack[-1]] <= top[j]:
                stack.pop()
            greater[j] = stack[-1] if stack else -1
            stack.append(j)
        out = []
        for j in range(len(top)):
            chain, k = [], j + 1 if j + 1 < len(top) else -1
            while k >= 0:
                chain.append(k)
                k = greater[k]
            out.append((table["symbol"].iloc[0], number[j], number[chain].tolist(), top[chain].tolist()))
        return pd.DataFrame(out, columns=["symbol", "__block", "blocks", "tops"])

    chain = slim.groupBy("symbol", "__block").agg(F.max("__v").alias("m")).groupBy("symbol").applyInPandas(chains, "symbol string, __block long, blocks array<long>, tops array<double>")

    def own(key, block: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("__row")
        levels = block["__l"].to_numpy(float)
        asked = np.flatnonzero(~np.isnan(levels))
        at = first_reaching(block["__v"].to_numpy(float), asked + 1, levels[asked])
        inside = at < len(block)
        times = block["ts"].to_numpy()
        hit = pd.Series(pd.NaT, index=range(len(asked)), dtype=block["ts"].dtype)
        hit[inside] = times[at[inside]]
        goal = np.full(len(asked), -1, np.int64)
        if len(later) and len(later["blocks"].iloc[0]):
            found = np.searchsorted(np.asarray(later["tops"].iloc[0], float), levels[asked], side="left")
            some = ~inside & (found < len(later["blocks"].iloc[0]))
            goal[some] = np.asarray(later["blocks"].iloc[0], np.int64)[found[some]]
        return pd.DataFrame({"symbol": key[0], "__row": block["__row"].to_numpy()[asked], "__l": levels[asked], "hit": hit, "goal": goal})

    asked = slim.groupBy("symbol", "__block").cogroup(chain.groupBy("symbol", "__block")).applyInPandas(own, f"symbol string, __row long, __l double, hit {time}, goal long")
    asked = settle(asked, "levels")
    left = asked.where("goal >= 0").select("symbol", "__row", "__l", F.col("goal").alias("__block"))
    copies = left.groupBy("symbol", "__block").agg(F.ceil(F.count("*") / CROWD).alias("copies"))
    left = left.join(copies, ["symbol", "__block"]).withColumn("copy", F.pmod("__row", "copies"))
    there = slim.join(copies, ["symbol", "__block"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))

    def goal(key, levels: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("__row")
        at = first_reaching(block["__v"].to_numpy(float), np.zeros(len(levels), np.int64), levels["__l"].to_numpy(float))
        return pd.DataFrame({"symbol": key[0], "__row": levels["__row"].to_numpy(), "hit": block["ts"].to_numpy()[at]})

    by = ["symbol", "__block", "copy"]
    far = left.select(*by, "__row", "__l").groupBy(*by).cogroup(there.select(*by, "__row", "ts", "__v").groupBy(*by)).applyInPandas(goal, f"symbol string, __row long, hit {time}")
    hits = asked.where("hit is not null").select("symbol", "__row", F.col("hit").alias(name)).unionByName(far.select("symbol", "__row", F.col("hit").alias(name)))
    return rows.join(hits, ["symbol", "__row"], "left").select(*bars.columns, name)


def gap_fills(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Fair value gaps and when they are filled: symbol, ts, side, bottom, top, filled.

    A rising gap lies between the high two bars ago and the low, if that is higher; a falling one between the high and the low two
    bars ago. It is filled by the first later bar that comes back to its far side.
    """

    def build(df: DataFrame) -> DataFrame:
        up, down = F.col("low") > before("high", 2), F.col("high") < before("low", 2)
        return df.withColumn("rising_gap", F.when(up, before("high", 2))).withColumn("falling_gap", F.when(down, before("low", 2)))

    with_gaps = blocked(bars.select("symbol", "ts", "high", "low"), build, 2, block_rows)
    both = next_reaching(next_reaching(with_gaps, "rising_gap", "low", False, "refilled", block_rows), "falling_gap", "high", True, "covered", block_rows)
    sides = F.array(F.struct(F.lit("rising").alias("side"), F.col("rising_gap").alias("bottom"), F.col("low").alias("top"), F.col("refilled").alias("filled")), F.struct(F.lit("falling").alias("side"), F.col("high").alias("bottom"), F.col("falling_gap").alias("top"), F.col("covered").alias("filled")))
    return both.select("symbol", "ts", F.inline(sides)).where(F.col("bottom").isNotNull() & F.col("top").isNotNull())


def structure_breaks(bars: DataFrame, reach: int = 5, block_rows: int | None = None) -> DataFrame:
    """Swing highs and lows and when a close breaks them: symbol, ts, side, level, broken.

    A swing high is a high that no bar within `reach` on either side exceeds, and that no earlier one of these equals; it is
    known only `reach` bars later, so closes count from there on.
    """

    def build(df: DataFrame) -> DataFrame:
        # the window ends at the bar where the swing is known
        around = ordered().rowsBetween(-2 * reach, 0)
        earlier = ordered().rowsBetween(-2 * reach, -reach - 1)
        high, low = before("high", reach), before("low", reach)
        full = F.count("high").over(around) == 2 * reach + 1
        swing_high = full & (high >= F.max("high").over(around)) & (high > F.max("high").over(earlier))
        swing_low = full & (low <= F.min("low").over(around)) & (low < F.min("low").over(earlier))
        return df.withColumn("swing_ts", before("ts", reach)).withColumn("swing_high", F.when(swing_high, high)).withColumn("swing_low", F.when(swing_low, low))

    swings = blocked(bars.select("symbol", "ts", "high", "low", "close"), build, 2 * reach, block_rows)
    found = next_reaching(next_reaching(swings, "swing_high", "close", True, "over", block_rows), "swing_low", "close", False, "under", block_rows)
    sides = F.array(F.struct(F.lit("high").alias("side"), F.col("swing_high").alias("level"), F.col("over").alias("broken")), F.struct(F.lit("low").alias("side"), F.col("swing_low").alias("level"), F.col("under").alias("broken")))
    return found.select("symbol", F.col("swing_ts").alias("ts"), F.inline(sides)).where(F.col("level").isNotNull())
