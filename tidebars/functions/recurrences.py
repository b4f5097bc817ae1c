"""Indicators that carry a state from bar to bar.

Exponential means are linear recurrences: what lies `memory` rows back weighs less than a double can tell, so
they are folded by blocks of a symbol, each led by so many rows, in one Arrow pass, many at once. Stops, ratchets and
the like aren't linear and may remember without bound; each is a small step function over one symbol's bars
in time order, whose bars are then one group (bars, not ticks: ten years of minutes are five million rows).
What a rolling window can express is in `indicators` instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidebars.functions.frames import blocked

#: name -> (function of a symbol's bars to named series, names of its columns)
FOLDS: dict[str, tuple[Callable[[pd.DataFrame], dict[str, np.ndarray]], list[str]]] = {}
#: Rows after which a fold has forgotten what was before; folds that aren't named here may not forget.
MEMORY: dict[str, int] = {}


def fold(*columns: str, memory: int | None = None):
    def add(step):
        FOLDS[step.__name__] = step, list(columns)
        if memory:
            MEMORY[step.__name__] = memory
        return step

    return add


def by_symbol(bars: DataFrame, step: Callable[[pd.DataFrame], dict], columns: list[str], key: str = "symbol", time: str = "ts") -> DataFrame:
    """bars with the double columns that step makes of each symbol's bars in time order; NaN becomes null."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in bars.dtypes) + "".join(f", `{c}` double" for c in columns)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable").reset_index(drop=True)
        found = step(rows)
        return rows.assign(**{c: np.asarray(found[c], float) for c in columns})

    from pyspark.sql import functions as F

    out = bars.groupBy(key).applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def apply(bars: DataFrame, *names: str, whole: bool = False, block_rows: int | None = None) -> DataFrame:
    """bars with the columns of the named folds, all in one pass; by blocks of a symbol if all of them forget, unless whole is set."""
    steps = [FOLDS[n][0] for n in names]
    columns = [c for n in names for c in FOLDS[n][1]]

    def every(rows: pd.DataFrame) -> dict:
        found: dict = {}
        for step in steps:
            found |= step(rows)
        return found

    def build(df: DataFrame) -> DataFrame:
        return by_symbol(df, every, columns)

    return build(bars) if whole or set(names) - set(MEMORY) else blocked(bars, build, max(MEMORY[n] for n in names), block_rows)


def _ewm(x, span: float | None = None, alpha: float | None = None, adjust: bool = True, least: int = 0) -> pd.Series:
    return pd.Series(x).ewm(span=span, alpha=alpha, adjust=adjust, min_periods=least).mean()


def ema(x, n: int, adjust: bool = True) -> pd.Series:
    """Exponential mean by span; adjust: weights normed over the bars so far."""
    return _ewm(x, span=n, adjust=adjust)


def rma(x, n: int) -> pd.Series:
    """Wilder's mean: weight 1/n, seeded with the first value, null before n values."""
    return _ewm(x, alpha=1 / n, adjust=False, least=n)


def true_range(b: pd.DataFrame) -> pd.Series:
    last = b["close"].shift()
    return pd.concat([b["high"] - b["low"], (b["high"] - last).abs(), (b["low"] - last).abs()], axis=1).max(axis=1)


@fold("ema_12", "ema_26", "ema_adj_20", "dema_20", "tema_20", memory=1024)
def ema_family(b):
    """Recursive and adjusted exponential means, double and triple."""
    one = ema(b["close"], 20, False)
    two = ema(one, 20, False)
    three = ema(two, 20, False)
    return {"ema_12": ema(b["close"], 12, False), "ema_26": ema(b["close"], 26, False), "ema_adj_20": ema(b["close"], 20), "dema_20": 2 * one - two, "tema_20": 3 * one - 3 * two + three}


@fold("macd", "macd_signal", "macd_hist", memory=1024)
def macd(b):
    line = ema(b["close"], 12) - ema(b["close"], 26)
    signal = ema(line, 9)
    return {"macd": line, "macd_signal": signal, "macd_hist": line - signal}


@fold("rsi_wilder", memory=1024)
def rsi_wilder(b):
    step = b["close"].diff()
    gain, loss = rma(step.clip(lower=0).fillna(0.0), 14), rma((-step).clip(lower=0).fillna(0.0), 14)
    with np.errstate(all="ignore"):
        return {"rsi_wilder": np.where((loss == 0) & (gain > 0), 100.0, 100 - 100 / (1 + gain / loss.where(loss != 0)))}


@fold("atr_wilder", "keltner_up", "keltner_low", memory=1024)
def atr_wilder(b):
    atr = rma(true_range(b), 14)
    mid = ema(b["close"], 20, False)
    return {"atr_wilder": atr, "keltner_up": mid + 2 * atr, "keltner_low": mid - 2 * atr}


@fold("plus_di_wilder", "minus_di_wilder", "adx_wilder", memory=1024)
def adx_wilder(b):
    up, down = b["high"].diff(), -b["low"].diff()
    atr = rma(true_range(b), 14)
    plus = 100 * rma(up.where((up > down) & (up > 0), 0.0), 14) / atr
    minus = 100 * rma(down.where((down > up) & (down > 0), 0.0), 14) / atr
    both = plus + minus
    dx = 100 * (plus - minus).abs() / both.where(both != 0)
    return {"plus_di_wilder": plus, "minus_di_wilder": minus, "adx_wilder": rma(dx, 14)}


@fold("tsi", "tsi_signal", memory=1024)
def tsi(b):
    step = b["close"].diff()
    top, bottom = ema(ema(step, 25), 13), ema(ema(step.abs(), 25), 13)
    line = 100 * top / bottom.where(bottom != 0)
    return {"tsi": line, "tsi_signal": ema(line, 7)}


@fold("bull_power", "bear_power", memory=1024)
def power(b):
    mid = ema(b["close"], 13)
    return {"bull_power": b["high"] - mid, "bear_power": b["low"] - mid}


@fold("stc")
def schaff(b):
    """Twice the stochastic of MACD, each smoothed by half."""
    line = ema(b["close"], 23, False) - ema(b["close"], 50, False)

    def place(x):
        low, high = x.rolling(10, min_periods=1).min(), x.rolling(10, min_periods=1).max()
        return _ewm((100 * (x - low) / (high - low).where(high > low)).ffill().fillna(0.0), alpha=0.5, adjust=False)

    return {"stc": place(place(line)).clip(0, 100)}


@fold("ha_open_rec", "ha_close_rec", memory=1024)
def heikin_ashi(b):
    """open = mean of the last open and close, recursively; close = mean of four prices."""
    close = ((b["open"] + b["high"] + b["low"] + b["close"]) / 4).to_numpy()
    start = np.concatenate([[(b["open"].iloc[0] + b["close"].iloc[0]) / 2], close[:-1]]) if len(b) else close
    return {"ha_open_rec": _ewm(start, alpha=0.5, adjust=False), "ha_close_rec": close}


@fold("supertrend", "supertrend_side")
def supertrend(b, n: int = 10, k: float = 3.0):
    """Bands of k mean ranges that only tighten while the last close holds them; the side flips when it doesn't."""
    atr = rma(true_range(b), n).to_numpy()
    mid, close = ((b["high"] + b["low"]) / 2).to_numpy(), b["close"].to_numpy()
    line, side = np.full(len(b), np.nan), np.full(len(b), np.nan)
    up = down = np.nan
    now = 1.0
    for i in range(len(b)):
        if np.isnan(atr[i]):
            continue
        low, high = mid[i] - k * atr[i], mid[i] + k * atr[i]
        last = close[i - 1] if i else np.nan
        new_up = max(low, up) if last > up else low
        new_down = min(high, down) if last < down else high
        if not np.isnan(up):
            now = 1.0 if now < 0 and close[i] > down else -1.0 if now > 0 and close[i] < up else now
        up, down = new_up, new_down
        line[i], side[i] = (up if now > 0 else down), now
    return {"supertrend": line, "supertrend_side": side}


@fold("sar")
def parabolic_sar(b, step: float = 0.02, most: float = 0.2):
    """A stop that closes in on the extreme price by a growing share, and turns when the price crosses it."""
    high, low = b["high"].to_numpy(), b["low"].to_numpy()
    out = np.full(len(b), np.nan)
    if len(b) < 2:
        return {"sar": out}
    rising = b["close"].iloc[1] >= b["close"].iloc[0]
    stop, extreme, share = (low[0], high[0], step) if rising else (high[0], low[0], step)
    for i in range(1, len(b)):
        stop += share * (extreme - stop)
        if rising:
            stop = min(stop, low[i - 1], low[max(0, i - 2)])
        else:
            stop = max(stop, high[i - 1], high[max(0, i - 2)])
        if (low[i] < stop) if rising else (high[i] > stop):
            rising, stop, share = not rising, extreme, step
            extreme = high[i] if rising else low[i]
        elif rising and high[i] > extreme or not rising and low[i] < extreme:
            extreme, share = (high[i] if rising else low[i]), min(most, share + step)
        out[i] = stop
    return {"sar": out}


@fold("half_trend", "half_trend_side")
def half_trend(b, n: int = 2):
    """Follows the lows' highest while rising and the highs' lowest while falling; turns when the mean price and the close agree."""
    top, bottom = b["high"].rolling(n, min_periods=1).max().to_numpy(), b["low"].rolling(n, min_periods=1).min().to_numpy()
    mean_high, mean_low = b["high"].rolling(n, min_periods=1).mean().to_numpy(), b["low"].rolling(n, min_periods=1).mean().to_numpy()
    close, high, low = (b[x].to_numpy() for x in ("close", "high", "low"))
    line, side = np.empty(len(b)), np.empty(len(b))
    now, peak, trough, level = 1.0, -np.inf, np.inf, np.nan
    for i in range(len(b)):
        was = now
        if now > 0:
            peak = max(peak, bottom[i])
            if i and mean_high[i] < peak and close[i] < low[i - 1]:
                now, trough = -1.0, top[i]
        else:
            trough = min(trough, top[i])
            if i and mean_low[i] > trough and close[i] > high[i - 1]:
                now, peak = 1.0, bottom[i]
        follow = peak if now > 0 else trough
        level = follow if now != was or not i else max(level, follow) if now > 0 else min(level, follow)
        line[i], side[i] = level, now
    return {"half_trend": line, "half_trend_side": side}


@fold("range_filter_line", "range_filter_side")
def range_filter(b, n: int = 50, k: float = 3.0):
    """A line that moves only as far as the price leaves it by k smoothed ranges; and which way it last moved."""
    x = b["close"].to_numpy()
    size = (ema(ema(b["close"].diff().abs(), n), 2 * n - 1) * k).to_numpy()
    line, side = np.empty(len(b)), np.zeros(len(b))
    for i in range(len(b)):
        r = 0.0 if np.isnan(size[i]) else size[i]
        last = line[i - 1] if i else x[0]
        line[i] = max(last, x[i] - r) if x[i] > last else min(last, x[i] + r)
        side[i] = np.sign(line[i] - last) or (side[i - 1] if i else 0.0)
    return {"range_filter_line": line, "range_filter_side": side}


def mcginley_path(x: np.ndarray, n: int, held: bool) -> np.ndarray:
    """From the first value on, steps towards x over n (x / last) ** 4; held: none goes past x, which keeps paths near 0 finite."""
    out, last = [], 0.0
    for value in x.tolist():
        if not last or not value:
            last = value or last
        else:
            pace = n * (value / last) ** 4
            last += (value - last) / (max(1.0, pace) if held else pace)
        out.append(last)
    return np.array(out)


@fold("mcginley")
def mcginley(b, n: int = 14):
    """The held path: close prices here can be near 0."""
    return {"mcginley": mcginley_path(b["close"].to_numpy(), n, True)}


@fold("mcginley_free")
def mcginley_free(b, n: int = 14):
    """The path as published, for prices well above 0: from the mean of the first n closes on, nothing before it."""
    x = b["close"].to_numpy(float)
    if len(x) < n:
        return {"mcginley_free": np.full(len(x), np.nan)}
    return {"mcginley_free": np.concatenate([np.full(n - 1, np.nan), mcginley_path(np.concatenate([[x[:n].mean()], x[n:]]), n, False)])}


@fold("b_xtrender", "ema_stack", "ema_cross", memory=4096)
def ema_crosses(b):
    """Side of the mean of 7 against that of 14; 1 or -1 where the means of 20, 50 and 200 stand in order; crossings of 50 and 200."""
    apart = lambda n, m: np.sign((ema(b["close"], n) - ema(b["close"], m)).round(9))  # noqa: E731  means of the same values are one
    short, middle, long = apart(7, 14), apart(20, 50), apart(50, 200)
    was = long.shift()
    return {
        "b_xtrender": np.where(short > 0, 1.0, -1.0), "ema_stack": np.where((middle > 0) & (long > 0), 1.0, np.where((middle < 0) & (long < 0), -1.0, 0.0)),
        "ema_cross": np.where((long > 0) & (was <= 0), 1.0, np.where((long < 0) & (was >= 0), -1.0, 0.0)),
    }


def conditional(column: str = "close", threshold: float | str = 0.0, n: int = 14):
    """A step for by_symbol: the exponential mean of the close, taken over only where column exceeds threshold (a number or a column); the first bar always counts."""

    def step(b):
        mean, on = ema(b["close"], n), (b[column] > (b[threshold] if isinstance(threshold, str) else threshold)).to_numpy()
        on[:1] = True
        return {"conditional_ema": mean.where(on).ffill()}

    return step


@fold("conditional_ema")
def conditional_ema(b):
    """Taken over only where the bar rises."""
    return conditional("close", "open")(b)


@fold("wolfpack", "tdfi", "range_size", "ehma", memory=1024)
def ema_oscillators(b):
    """Mean of 3 less mean of 8; trend direction force of 13 over the largest of 39; twice smoothed mean step of 14 times 2.618;
    the exponential Hull mean of 16. All by recursive means."""
    c = b["close"]
    one = ema(c * 1000, 13, False)
    two = ema(one, 13, False)
    force = (one - two).abs() * ((one.diff() + two.diff()) / 2) ** 3
    step = c.diff().abs()
    peak = force.abs().rolling(39, min_periods=1).max()
    return {
        "wolfpack": ema(c, 3, False) - ema(c, 8, False), "tdfi": force / peak.where(peak != 0), "range_size": 2.618 * ema(ema(step, 14, False), 27, False),
        "ehma": ema(2 * ema(c, 8, False) - ema(c, 16, False), 4, False),
    }


@fold("waddah_trend", "waddah_band", "waddah_dead", "waddah_side", memory=4096)
def waddah_explosion(b):
    """150 times the step of the means of 20 less 40; the width of the band of 2 deviations; 3.7 mean ranges of 100, 0 before there are
    so many; 1 or -1 where the step is beyond the width and both are beyond the ranges."""
    c = b["close"]
    trend = 150 * (ema(c, 20, False) - ema(c, 40, False)).diff()
    band, dead = 4 * c.rolling(20).std(ddof=0), (3.7 * rma(true_range(b), 100)).fillna(0.0)
    strong = (trend.abs() > band) & (band > dead) & (trend.abs() > dead)
    return {"waddah_trend": trend, "waddah_band": band, "waddah_dead": dead, "waddah_side": np.where(strong, np.sign(trend), 0.0)}


@fold("chandelier_stop", "chandelier_side")
def chandelier_exit(b, n: int = 22, k: float = 3.0):
    """Stops k ranges from the extreme that only tighten; the side turns when the close passes the other's last stop."""
    atr = rma(true_range(b), n).to_numpy() * k
    top, bottom = b["close"].rolling(n, min_periods=1).max().to_numpy(), b["close"].rolling(n, min_periods=1).min().to_numpy()
    x = b["close"].to_numpy()
    stop, side = np.full(len(b), np.nan), np.full(len(b), np.nan)
    long = short = np.nan
    now = 1.0
    for i in range(len(b)):
        if np.isnan(atr[i]):
            continue
        last_long, last_short = long, short
        long, short = top[i] - atr[i], bottom[i] + atr[i]
        if i and x[i - 1] > last_long:
            long = max(long, last_long)
        if i and x[i - 1] < last_short:
            short = min(short, last_short)
        now = 1.0 if x[i] > last_short else -1.0 if x[i] < last_long else now
        stop[i], side[i] = (long if now > 0 else short), now
    return {"chandelier_stop": stop, "chandelier_side": side}


@fold("qqe_line", "qqe_stop")
def qqe(b, n: int = 14, smooth: int = 5, factor: float = 4.238):
    """The smoothed RSI and a trailing stop on it, at `factor` smoothed moves."""
    line = ema(pd.Series(rsi_wilder(b)["rsi_wilder"]), smooth, False)
    move = rma(rma(line.diff().abs(), 2 * n - 1), 2 * n - 1).to_numpy() * factor
    x, stop = line.to_numpy(), np.full(len(b), np.nan)
    long = short = np.nan
    now = 1
    for i in range(len(b)):
        if np.isnan(move[i]) or np.isnan(x[i]):
            continue
        low, high = x[i] - move[i], x[i] + move[i]
        was_long, was_short = long, short
        long = max(low, was_long) if i and x[i - 1] > was_long and x[i] > was_long else low
        short = min(high, was_short) if i and x[i - 1] < was_short and x[i] < was_short else high
        now = 1 if x[i] > was_short else -1 if x[i] < was_long else now
        stop[i] = long if now > 0 else short
    return {"qqe_line": x, "qqe_stop": stop}


@fold("zigzag")
def zigzag(b, n: int = 10, k: float = 2.0):
    """1 at a confirmed top and -1 at a confirmed bottom: the price has turned by k mean ranges since."""
    atr = _ewm(true_range(b), alpha=1 / n, adjust=False).to_numpy() * k
    high, low = b["high"].to_numpy(), b["low"].to_numpy()
    out, way, at_high, at_low = np.zeros(len(b)), 0, 0, 0
    for i in range(len(b)):
        if high[i] >= high[at_high] or way < 0 and at_high < at_low:
            at_high = i if high[i] >= high[at_high] or at_high < at_low else at_high
        if low[i] <= low[at_low] or way > 0 and at_low < at_high:
            at_low = i if low[i] <= low[at_low] or at_low < at_high else at_low
        if way >= 0 and at_high < i and high[at_high] - low[i] >= atr[i]:
            out[at_high], way, at_low = 1, -1, i
        elif way <= 0 and at_low < i and high[i] - low[at_low] >= atr[i]:
            out[at_low], way, at_high = -1, 1, i
    return {"zigzag": out}
