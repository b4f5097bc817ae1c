"""Backtests: running sums where positions follow signals, and a fold where exits depend on the trade so far."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.frames import before, blocked, deviation, ordered, rows, safe, so_far
from tidebars.operators.stats import quantiles
from tidebars.plans.linear import numbered


def cumulative(bars: DataFrame, signal: str = "signal", cash: float = 10_000.0) -> DataFrame:
    """position: the running sum of signals; equity: cash plus the position at the close (no cash is debited)."""
    df = bars.withColumn("position", F.sum(F.coalesce(F.col(signal), F.lit(0))).over(so_far()))
    return df.withColumn("equity", cash + F.col("position") * F.col("close"))


def held(bars: DataFrame, position: str = "position") -> DataFrame:
    """strategy_return: the last bar's position times this bar's return; growth: their running product; drawdown from its peak."""
    step = F.coalesce(safe(F.col("close"), before("close")) - 1, F.lit(0.0))
    df = bars.withColumn("strategy_return", F.coalesce(before(position), F.lit(0)) * step)
    df = df.withColumn("growth", F.exp(F.sum(F.log1p(F.greatest(F.col("strategy_return"), F.lit(-0.999999)))).over(so_far())))
    return df.withColumn("drawdown", F.col("growth") / F.max("growth").over(so_far()) - 1)


def summary(bars: DataFrame, periods: float = 8760.0) -> DataFrame:
    """For each symbol: total return, Sharpe, Sortino and Calmar ratios, and the largest drawdown. bars: of held()."""
    r = F.col("strategy_return")
    out = bars.groupBy("symbol").agg(
        (F.max_by("growth", "ts") - 1).alias("total_return"), F.avg(r).alias("__mean"), F.stddev_samp(r).alias("__sd"), F.stddev_samp(F.when(r < 0, r)).alias("__down"), F.min("drawdown").alias("max_drawdown"), F.count("*").alias("bars"),
    )
    root = periods**0.5
    ratios = {"sharpe": safe(F.col("__mean"), F.col("__sd")) * root, "sortino": safe(F.col("__mean"), F.col("__down")) * root, "calmar": safe(F.col("total_return"), -F.col("max_drawdown"))}
    return out.withColumns(ratios).drop("__mean", "__sd", "__down")


@dataclass(frozen=True)
class Rules:
    """Exits of a single position: shares of the entry price, bars, and fees of either kind."""

    stop: float = 0.02
    target: float = 0.04
    trail: float = 0.0
    partial: float = 0.0  # share closed at half the target; the stop then moves to the entry price
    most_bars: int = 48
    cooldown: int = 2
    day_trades: int = 5
    maker_fee: float = 0.0002
    taker_fee: float = 0.0005


TRADES = "symbol string, side int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, exit_price double, pnl_pct double, bars int, reason string"


def _run(symbol: str, ts: np.ndarray, close: np.ndarray, high: np.ndarray, low: np.ndarray, signal: np.ndarray, day: np.ndarray, rules: Rules) -> list[tuple]:
    """The trades of one symbol. Stops are looked at before targets; emergency exits pay the taker's fee."""
    out: list[tuple] = []
    side, entry, entry_at, best, stop, share, banked, free_at = 0, 0.0, 0, 0.0, 0.0, 1.0, 0.0, 0
    per_day: dict = {}

    def leave(i: int, price: float, reason: str) -> None:
        nonlocal side, free_at
        fee = rules.maker_fee + (rules.taker_fee if reason in ("stop", "trail") else rules.maker_fee)
        gain = banked + share * side * (price / entry - 1) - fee
        out.append((symbol, side, ts[entry_at], ts[i], entry, price, 100 * gain, i - entry_at, reason))
        side, free_at = 0, i + rules.cooldown

    for i in range(len(close)):
        if side:
            best = max(best, high[i]) if side > 0 else min(best, low[i])
            against, towards = (low[i], high[i]) if side > 0 else (high[i], low[i])
            limit, reason = stop, "stop"
            if rules.trail and side * (best * (1 - side * rules.trail) - limit) > 0:
                limit, reason = best * (1 - side * rules.trail), "trail"
            goal = entry * (1 + side * rules.target)
            if side * (against - limit) <= 0:
                leave(i, limit, reason)
            elif side * (towards - goal) >= 0:
                leave(i, goal, "target")
            elif i - entry_at >= rules.most_bars:
                leave(i, close[i], "time")
            elif signal[i] == -side:
                leave(i, close[i], "signal")
            elif rules.partial and share == 1.0 and side * (towards - entry * (1 + side * rules.target / 2)) >= 0:
                banked, share, stop = rules.partial * rules.target / 2, 1 - rules.partial, entry
        if not side and signal[i] and i >= free_at and close[i] > 0 and per_day.get(day[i], 0) < rules.day_trades:
            per_day[day[i]] = per_day.get(day[i], 0) + 1
            side, entry, entry_at, best, share, banked = int(signal[i]), close[i], i, close[i], 1.0, 0.0
            stop = entry * (1 - side * rules.stop)
    if side:
        leave(len(close) - 1, close[-1], "end")
    return out


def trades(bars: DataFrame, rules: Rules = Rules(), signal: str = "signal") -> DataFrame:
    """The trades of each symbol, one position at a time."""
    chosen = bars.select("symbol", "ts", "close", "high", "low", F.coalesce(F.col(signal), F.lit(0)).cast("int").alias("signal"))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts", kind="stable")
        found = _run(key[0], b["ts"].to_numpy(), *(b[c].to_numpy() for c in ("close", "high", "low", "signal")), b["ts"].dt.date.to_numpy(), rules)
        return pd.DataFrame(found, columns=[part.split()[0] for part in TRADES.split(", ")])

    return chosen.groupBy("symbol").applyInPandas(run, TRADES)


def grid(bars: DataFrame, rules: list[Rules], signal: str = "signal") -> DataFrame:
    """A row for each symbol and set of rules: trades, mean and sum of gains, share of wins. Each (symbol, set) is a task's group."""
    spark = bars.sparkSession
    sets = spark.createDataFrame([(i, *asdict(r).values()) for i, r in enumerate(rules)], "rule int, stop double, target double, trail double, partial double, most_bars int, cooldown int, day_trades int, maker_fee double, taker_fee double")
    chosen = bars.select("symbol", "ts", "close", "high", "low", F.coalesce(F.col(signal), F.lit(0)).cast("int").alias("signal"))
    crossed = chosen.withColumn("rule", F.explode(F.sequence(F.lit(0), F.lit(len(rules) - 1))))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts", kind="stable")
        found = _run(key[0], b["ts"].to_numpy(), *(b[c].to_numpy() for c in ("close", "high", "low", "signal")), b["ts"].dt.date.to_numpy(), rules[key[1]])
        gains = np.array([t[6] for t in found])
        return pd.DataFrame([(key[0], int(key[1]), len(gains), gains.mean() if len(gains) else 0.0, gains.sum(), float((gains > 0).mean()) if len(gains) else 0.0)], columns=["symbol", "rule", "trades", "mean_gain", "total_gain", "win_rate"])

    out = crossed.groupBy("symbol", "rule").applyInPandas(run, "symbol string, rule int, trades int, mean_gain double, total_gain double, win_rate double")
    return out.join(F.broadcast(sets), "rule")


def patterns(found: DataFrame) -> DataFrame:
    """Trades by hour of entry and reason of exit."""
    return found.groupBy(F.hour("entry_ts").alias("hour"), "reason").agg(F.count("*").alias("trades"), F.avg("pnl_pct").alias("mean_gain"), F.avg("bars").alias("mean_bars"))


def on_off(bars: DataFrame, position: str) -> DataFrame:
    """Per symbol: mean, population deviation and growth of the held position's returns, and of the price's own."""
    df = bars.withColumn("__r", safe(F.col("close"), before("close")) - 1).withColumn("__s", before(position) * F.col("__r"))
    grown = lambda c: F.exp(F.sum(F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(-0.999999))))) - 1
    out = df.groupBy("symbol").agg(*[e for n, c in (("strategy", "__s"), ("holding", "__r")) for e in (F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"), grown(c).alias(f"{n}_growth"))])
    return out.withColumns({f"{n}_sharpe": safe(F.col(f"{n}_mean"), F.col(f"{n}_std")) for n in ("strategy", "holding")})


# What counts for a class of indicators, and how much.
CLASS_WEIGHTS = {
    "trend_following": {"total_return": 0.25, "sharpe_ratio": 0.20, "max_drawdown": 0.15, "win_rate": 0.08, "profit_factor": 0.10, "avg_trade_pnl": 0.05, "trend_capture_ratio": 0.12, "avg_holding_period": 0.05},
    "oscillators": {"total_return": 0.20, "sharpe_ratio": 0.15, "max_drawdown": 0.20, "win_rate": 0.20, "profit_factor": 0.10, "avg_trade_pnl": 0.05, "reversal_accuracy": 0.10},
    "volume_based": {"total_return": 0.15, "sharpe_ratio": 0.15, "max_drawdown": 0.15, "win_rate": 0.15, "profit_factor": 0.15, "volume_confirmation_rate": 0.25},
    "volatility": {"total_return": 0.20, "sharpe_ratio": 0.20, "max_drawdown": 0.25, "win_rate": 0.10, "profit_factor": 0.10, "volatility_adaptation": 0.15},
    "levels_zones": {"total_return": 0.25, "sharpe_ratio": 0.15, "max_drawdown": 0.15, "win_rate": 0.25, "profit_factor": 0.10, "level_accuracy": 0.10},
    "systemic": {"total_return": 0.25, "sharpe_ratio": 0.20, "max_drawdown": 0.20, "win_rate": 0.15, "profit_factor": 0.10, "time_based_consistency": 0.10},
}
# Fixed values: (added, divisor) that bring a measure into 0 to 1, where it is then cut; others count as they are.
CLASS_RANGES = {"total_return": (0.5, 1.0), "sharpe_ratio": (1.0, 3.0), "profit_factor": (0.0, 3.0), "avg_trade_pnl": (100.0, 200.0), "max_drawdown": (-0.5, -0.5), "avg_holding_period": (-604800.0, -604800.0)}
#: Quarter hours of 252 days.
_YEAR = 252 * 24 * 4


def trade_measures(found: DataFrame, bars: DataFrame, capital: float = 10_000.0, order: tuple[str, ...] = ("entry_ts",)) -> DataFrame:
    """A row for each symbol with trades: what CLASS_WEIGHTS weighs. found: symbol, entry_ts, pnl, pnl_pct, holding (seconds).

    trend_capture_ratio: the share of the profit from trades that begin in a bar whose move exceeds 1.5 deviations of 20 moves;
    reversal_accuracy: winners among trades that begin where the move turned; volume_confirmation_rate: trades that begin on more
    volume than the mean of three bars before, the bar itself and one after; volatility_adaptation: profit of trades that begin
    in the upper 30 percent of deviations, to that of the others; level_accuracy: winners; time_based_consistency: how alike the
    hours of entry are. avg_holding_period is in seconds. A measure without trades to go by is 0.
    """
    move = safe(F.col("close"), before("close")) - 1
    shown = blocked(
        bars.select("symbol", "ts", "close", "volume"),
        lambda df: df.withColumn("x_r", move).withColumns({"x_sd": deviation("x_r", 20), "x_was": before("x_r")}).withColumn("x_before", F.sum("volume").over(rows(-3, 0))),
        21,
    )
    # the bar after is needed too: a lead of two tells whether it isn't one of the last two
    ends = bars.groupBy("symbol").agg(F.count("*").alias("__all"))
    after = numbered(shown).join(ends, "symbol")
    later = after.select("symbol", (F.col("row") - 1).alias("row"), F.col("volume").alias("__next"))
    after = after.join(later, ["symbol", "row"], "left")
    high = quantiles(shown, ["symbol"], "x_sd", {"__high": 0.7})
    entry = after.join(high, "symbol").select(
        "symbol", F.col("ts").alias("entry_ts"), F.coalesce(F.abs("x_r") > 1.5 * F.col("x_sd"), F.lit(False)).alias("__trend"), F.coalesce(F.col("x_r") * F.col("x_was") < 0, F.lit(False)).alias("__turn"),
        F.coalesce(F.col("x_sd") > F.col("__high"), F.lit(False)).alias("__wild"), F.when((F.col("row") >= 3) & (F.col("row") < F.col("__all") - 2), F.col("volume") > (F.col("x_before") + F.col("__next")) / 5).alias("__full"),
    )
    at_bar = {c: F.coalesce(c, F.lit(False)) for c in ("__trend", "__turn", "__wild")}
    df = found.join(entry, ["symbol", "entry_ts"], "left").withColumns(at_bar)
    run = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__equity", capital + F.sum("pnl").over(run)).withColumn("__peak", F.greatest(F.lit(capital), F.max("__equity").over(run)))
    pnl, won = F.col("pnl"), F.col("pnl") > 0
    part = lambda test: F.sum(F.when(test, pnl).otherwise(0.0))
    share = lambda yes, of: F.coalesce(safe(F.sum(F.when(yes & of, 1.0).otherwise(0.0)), F.sum(F.when(of, 1.0).otherwise(0.0))), F.lit(0.0))
    loss, wild, calm = -part(pnl < 0), part(F.col("__wild")), part(~F.col("__wild"))
    out = df.groupBy("symbol").agg(
        F.count("*").alias("trades"), (F.sum(pnl) / capital).alias("total_return"), F.coalesce(safe(F.avg("pnl_pct"), F.stddev_pop("pnl_pct")) * _YEAR**0.5, F.lit(0.0)).alias("sharpe_ratio"),
        F.max((F.col("__peak") - F.col("__equity")) / F.col("__peak")).alias("max_drawdown"), share(won, F.lit(True)).alias("win_rate"), F.when(loss > 0, part(won) / loss).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.avg(pnl).alias("avg_trade_pnl"), F.avg("holding").alias("avg_holding_period"), F.coalesce(F.abs(safe(part(F.col("__trend")), F.sum(pnl))), F.lit(0.0)).alias("trend_capture_ratio"), share(won, F.col("__turn")).alias("reversal_accuracy"),
        F.coalesce(F.avg(F.col("__full").cast("double")), F.lit(0.0)).alias("volume_confirmation_rate"),
        F.when(~F.bool_or("__wild"), 0.0).when(calm == 0, F.when(wild > 0, 1.0).otherwise(0.0)).otherwise(wild / F.abs(calm)).alias("volatility_adaptation"), share(won, F.lit(True)).alias("level_accuracy"),
    )
    hours = found.groupBy("symbol", F.hour("entry_ts").alias("h")).agg(F.avg("pnl").alias("m")).groupBy("symbol").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop("m") / (F.abs(F.avg("m")) + 1e-8))).alias("time_based_consistency"))
    return out.join(hours, "symbol")


def class_scores(measures: DataFrame, weights: dict[str, dict[str, float]] = CLASS_WEIGHTS) -> DataFrame:
    """measures (of trade_measures) with a row for each class of indicators: class, score, the weighted mean of its measures within 0 and 1."""

    def scaled(name: str):
        add, by = CLASS_RANGES.get(name, (0.0, 1.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(name) + add) / by))

    scores = [F.struct(F.lit(c).alias("class"), (sum((scaled(n) * w for n, w in own.items()), F.lit(0.0)) / sum(own.values())).alias("score")) for c, own in weights.items()]
    return measures.select("*", F.inline(F.array(*scores)))


def by_part(parted: DataFrame, rules: Rules = Rules(), signal: str = "signal") -> DataFrame:
    """Trades of each symbol and part of a split, run apart. parted: bars with `part`."""
    chosen = parted.select("symbol", "part", "ts", "close", "high", "low", F.coalesce(F.col(signal), F.lit(0)).cast("int").alias("signal"))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts", kind="stable")
        found = _run(key[0], b["ts"].to_numpy(), *(b[c].to_numpy() for c in ("close", "high", "low", "signal")), b["ts"].dt.date.to_numpy(), rules)
        return pd.DataFrame(found, columns=[part.split()[0] for part in TRADES.split(", ")]).assign(part=key[1])

    return chosen.groupBy("symbol", "part").applyInPandas(run, TRADES + ", part string")
