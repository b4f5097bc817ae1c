"""Indicators that are windows over bars: every one adds named columns to a table of bars.

One name has many formulas, so variants have names of their own: what a registry entry computes is its
docstring. All of it is column expressions over bounded frames or running totals.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebars.functions.frames import before, blocked, carry, change, deviation, highest, lowest, mean, ordered, quantile, returns, rolling, rows, safe, so_far, stacked, total, values, weighted, whole

def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def bar_middle() -> Column:
    return (F.col("high") + F.col("low")) / 2


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str  # trend, momentum, volatility, volume, levels or pattern
    build: Callable[..., DataFrame]

    @property
    def about(self) -> str:
        return (self.build.__doc__ or "").strip()


INDICATORS: dict[str, Spec] = {}
#: At their defaults, indicators look back on fewer rows than this, but for those of UNBOUNDED.
LOOKBACK = 256
#: These carry a state or running totals, look ahead, or go by calendar days, and run by symbol.
UNBOUNDED = frozenset(
    "accumulation band_oscillator cma donchian_trend fractals ichimoku liquidity_zone obv pivots range_filter_direction ssl_channel stages supply_demand swing_labels vwap vwap_anchored".split()
)


def indicator(kind: str):
    def add(build):
        INDICATORS[build.__name__] = Spec(build.__name__, kind, build)
        return build

    return add


def apply(bars: DataFrame, *names: str, whole: bool = False, block_rows: int | None = None) -> DataFrame:
    """bars with the columns of each named indicator at its defaults; by blocks of a symbol unless one is unbounded, or whole is set."""

    def build(df: DataFrame) -> DataFrame:
        for name in names:
            df = INDICATORS[name].build(df)
        return df

    return build(bars) if whole or UNBOUNDED & set(names) else blocked(bars, build, LOOKBACK, block_rows)


def true_range() -> Column:
    """max(high - low, |high - last close|, |low - last close|); the first bar's is high - low."""
    last = before("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


# --- moving averages


@indicator("trend")
def sma(df, n: int = 20, x: str = "close"):
    """Mean of the last n."""
    return df.withColumn(f"sma_{n}", mean(x, n))


@indicator("trend")
def wma(df, n: int = 10, x: str = "close"):
    """Linear weights, the newest heaviest."""
    return df.withColumn(f"wma_{n}", weighted(x, [k / (n * (n + 1) / 2) for k in range(1, n + 1)]))


def _linear(n: int) -> list[float]:
    return [k / (n * (n + 1) / 2) for k in range(1, n + 1)]


@indicator("trend")
def hma(df, n: int = 16, x: str = "close"):
    """WMA over sqrt(n) of twice the WMA over n/2 less the WMA over n."""
    raw = 2 * weighted(x, _linear(n // 2)) - weighted(x, _linear(n))
    return stacked(df, {"__raw": raw}, {f"hma_{n}": weighted("__raw", _linear(int(math.sqrt(n))))}).drop("__raw")


@indicator("trend")
def vwma(df, n: int = 20):
    """Mean weighted by volume."""
    return df.withColumn(f"vwma_{n}", safe(total(F.col("close") * F.col("volume"), n), total(F.col("volume"), n)))


@indicator("trend")
def cma(df):
    """Mean so far, from the third bar on."""
    return df.withColumn("cma", F.when(F.row_number().over(ordered()) > 2, F.avg("close").over(so_far())))


@indicator("trend")
def fir_ewma(df, n: int = 10, alpha: float = 0.2):
    """Exponential weights over exactly n bars, normed to 1."""
    raw = [(1 - alpha) ** (n - 1 - k) for k in range(n)]
    return df.withColumn("fir_ewma", weighted("close", [w / sum(raw) for w in raw]))


@indicator("trend")
def kernel_regression(df, n: int = 25, width: float = 8.0, ratio: float = 8.0):
    """Rational quadratic kernel over the last n closes: weights (1 + i^2 / (2 r w^2))^-r."""
    raw = [(1 + (n - 1 - k) ** 2 / (2 * ratio * width**2)) ** -ratio for k in range(n)]
    df = df.withColumn("rq_kernel", weighted("close", [w / sum(raw) for w in raw]))
    return df.withColumn("rq_kernel_trend", F.signum(change("rq_kernel")))


@indicator("trend")
def centre_of_gravity(df, n: int = 10):
    """-sum(x_j (n - j)) / sum(x_j) over the last n."""
    return df.withColumn("cog", -safe(weighted("close", [float(n - j) for j in range(n)]), total("close", n)))


@indicator("trend")
def donchian_trend(df, n: int = 20):
    """1 from a close over the highest of the n bars before, -1 from one under the lowest, carried on."""
    up, down = highest("high", n, shift=1), lowest("low", n, shift=1)
    return stacked(df, {"__up": up, "__down": down}, {"donchian_trend": F.coalesce(carry(F.when(F.col("close") > F.col("__up"), 1).when(F.col("close") < F.col("__down"), -1)), F.lit(0))}).drop("__up", "__down")


@indicator("trend")
def ssl_channel(df, n: int = 10):
    """Means of highs and lows, swapped while the close was last under the mean of lows."""
    df = stacked(df, {"__h": mean("high", n), "__l": mean("low", n)}, {"__side": carry(F.when(F.col("close") > F.col("__h"), 1).when(F.col("close") < F.col("__l"), -1))})
    down = F.col("__side") < 0
    return df.withColumns({"ssl_up": F.when(down, F.col("__l")).otherwise(F.col("__h")), "ssl_down": F.when(down, F.col("__h")).otherwise(F.col("__l"))}).drop("__h", "__l", "__side")


@indicator("trend")
def range_filter_direction(df, n: int = 14, k: float = 1.0):
    """1 from a close over the last one by k mean true ranges, -1 from one under it, carried on, else 0."""
    df = stacked(df, {"__tr": true_range()}, {"__atr": mean("__tr", n)})
    last = before("close")
    event = F.when(F.col("close") > last + k * F.col("__atr"), 1).when(F.col("close") < last - k * F.col("__atr"), -1)
    return stacked(df, {"__event": event}, {"range_filter": F.coalesce(carry(F.col("__event")), F.lit(0))}).drop("__tr", "__atr", "__event")


@indicator("trend")
def ichimoku(df, a: int = 9, b: int = 26, s: int = 52, shift: int = 26):
    """Middles of ranges over a, b and s bars; spans shown `shift` bars later; the lagging close."""

    def middle(n: int) -> Column:
        return (highest("high", n) + lowest("low", n)) / 2

    df = df.withColumns({"tenkan": middle(a), "kijun": middle(b), "__s": middle(s)})
    return stacked(df, {"senkou_a": before((F.col("tenkan") + F.col("kijun")) / 2, shift), "senkou_b": before("__s", shift), "chikou": before("close", shift)}).drop("__s")


@indicator("trend")
def aroon(df, n: int = 14):
    """Share of the window since its last highest high and lowest low, in percent."""
    df = df.withColumns({"__h": values("high", n), "__l": values("low", n)})

    def since(name: str, pick) -> Column:
        return (F.array_position(F.reverse(name), pick(name)) - 1).cast("double")

    return df.withColumns({"aroon_up": (n - since("__h", F.array_max)) / n * 100, "aroon_down": (n - since("__l", F.array_min)) / n * 100}).drop("__h", "__l")


@indicator("trend")
def adx_sma(df, n: int = 14):
    """Directional movement with plain means: the larger move counts if it is up or down by more than the other."""
    up, down = change("high"), -change("low")
    df = df.withColumns({"__up": up, "__down": down, "__tr": true_range()})
    plus = F.when((F.col("__up") > F.col("__down")) & (F.col("__up") > 0), F.col("__up")).otherwise(0.0)
    minus = F.when((F.col("__down") > F.col("__up")) & (F.col("__down") > 0), F.col("__down")).otherwise(0.0)
    df = stacked(df, {"__p": plus, "__m": minus}, {"plus_di": 100 * safe(mean("__p", n), mean("__tr", n)), "minus_di": 100 * safe(mean("__m", n), mean("__tr", n))})
    dx = 100 * safe(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))
    return stacked(df, {"__dx": dx}, {"adx_sma": mean("__dx", n)}).drop("__up", "__down", "__tr", "__p", "__m", "__dx")


@indicator("trend")
def vortex(df, n: int = 14):
    """Sums of |high - last low| and |low - last high| over the true range's."""
    df = df.withColumns({"__p": F.abs(F.col("high") - before("low")), "__m": F.abs(F.col("low") - before("high")), "__tr": true_range()})
    return df.withColumns({"vortex_plus": safe(total("__p", n), total("__tr", n)), "vortex_minus": safe(total("__m", n), total("__tr", n))}).drop("__p", "__m", "__tr")


@indicator("trend")
def linear_fit(df, n: int = 14):
    """Slope of the least-squares line through the last n closes, by bar."""
    df = df.withColumn("__i", F.row_number().over(ordered()).cast("double"))
    w = rows(-(n - 1))
    return df.withColumn("slope", F.when(F.count("close").over(w) >= n, F.regr_slope(F.col("close"), F.col("__i")).over(w))).drop("__i")


# --- momentum


@indicator("momentum")
def rsi_sma(df, n: int = 14):
    """100 - 100 / (1 + mean gain / mean loss); the first change counts as 0, and no loss gives 100."""
    step = change("close")
    df = df.withColumns({"__gain": F.when(step > 0, step).otherwise(0.0), "__loss": F.when(step < 0, -step).otherwise(0.0)})
    gain, loss = mean("__gain", n), mean("__loss", n)
    return stacked(df, {"__g": gain, "__s": loss}, {"rsi": F.when((F.col("__s") == 0) & (F.col("__g") > 0), 100.0).otherwise(100 - 100 / (1 + safe(F.col("__g"), F.col("__s"))))}).drop("__gain", "__loss", "__g", "__s")


@indicator("momentum")
def stochastic(df, n: int = 14, d: int = 3):
    """The close's place in the range of the last n, in percent, and its mean."""
    k = 100 * safe(F.col("close") - lowest("low", n), highest("high", n) - lowest("low", n))
    return stacked(df, {"stoch_k": k}, {"stoch_d": mean("stoch_k", d)})


@indicator("momentum")
def kdj(df, n: int = 9, k: int = 9, d: int = 9):
    """K and D are means of the close's place in the range; J = 3K - 2D."""
    rsv = 100 * safe(F.col("close") - lowest("low", n), highest("high", n) - lowest("low", n))
    return stacked(df, {"__rsv": rsv}, {"kdj_k": mean("__rsv", k)}, {"kdj_d": mean("kdj_k", d)}, {"kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d")}).drop("__rsv")


@indicator("momentum")
def stochastic_rsi(df, n: int = 14):
    """The RSI's place in its own range over n, in percent."""
    return stacked(rsi_sma(df, n), {"stoch_rsi": 100 * safe(F.col("rsi") - lowest("rsi", n), highest("rsi", n) - lowest("rsi", n))})


@indicator("momentum")
def williams_r(df, n: int = 14):
    """-100 (highest - close) / range."""
    return df.withColumn("williams_r", -100 * safe(highest("high", n) - F.col("close"), highest("high", n) - lowest("low", n)))


@indicator("momentum")
def cci(df, n: int = 20):
    """(typical - mean) / (0.015 mean absolute deviation)."""
    df = stacked(df, {"__tp": typical()}, {"__all": values("__tp", n), "__mean": mean("__tp", n)})
    mad = F.aggregate("__all", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("__mean"))) / n
    return df.withColumn("cci", safe(F.col("__tp") - F.col("__mean"), 0.015 * mad)).drop("__tp", "__all", "__mean")


@indicator("momentum")
def cmo(df, n: int = 14):
    """100 (ups - downs) / (ups + downs) over the last n - 1 changes."""
    step = change("close")
    df = df.withColumns({"__u": F.when(step > 0, step).when(step.isNotNull(), 0.0), "__d": F.when(step < 0, -step).when(step.isNotNull(), 0.0)})
    up, down = total("__u", n - 1), total("__d", n - 1)
    return df.withColumn("cmo", 100 * safe(up - down, up + down)).drop("__u", "__d")


@indicator("momentum")
def momentum(df, n: int = 10):
    """Close less the close n bars before, and the change in percent."""
    return df.withColumns({"momentum": change("close", n), "roc": 100 * returns("close", n)})


@indicator("momentum")
def detrended_price(df, n: int = 20):
    """Close less the mean of n as it was n/2 + 1 bars before."""
    return df.withColumn("dpo", F.col("close") - mean("close", n, shift=n // 2 + 1))


@indicator("momentum")
def awesome(df, fast: int = 5, slow: int = 34):
    """Difference of two means of the bars' middles, and its difference from its mean over `fast`."""
    return stacked(df, {"__m": bar_middle()}, {"ao": mean("__m", fast) - mean("__m", slow)}, {"ac": F.col("ao") - mean("ao", fast)}).drop("__m")


@indicator("momentum")
def zscore(df, n: int = 96, least: int = 30, x: str = "close"):
    """(x - mean) / population deviation over up to n, from `least` values on."""
    return df.withColumn("zscore", safe(F.col(x) - mean(x, n, least=least), deviation(x, n, 0, least=least)))


@indicator("momentum")
def return_zscore(df, n: int = 50):
    """The return's distance from the mean of the n before, in their deviations."""
    return stacked(df, {"__r": returns("close")}, {"return_z": safe(F.col("__r") - mean("__r", n, shift=1), deviation("__r", n, 1, shift=1))}).drop("__r")


# --- volatility


@indicator("volatility")
def atr_sma(df, n: int = 14):
    """Mean true range."""
    return stacked(df, {"tr": true_range()}, {"atr_sma": mean("tr", n)})


@indicator("volatility")
def atr_open(df, n: int = 14):
    """Mean of max(open - low, |high - open|, |low - open|)."""
    return stacked(df, {"__tr": F.greatest(F.col("open") - F.col("low"), F.abs(F.col("high") - F.col("open")), F.abs(F.col("low") - F.col("open")))}, {"atr_open": mean("__tr", n)}).drop("__tr")


@indicator("volatility")
def bollinger(df, n: int = 20, k: float = 2.0):
    """Mean and sample deviations; %B; width."""
    df = df.withColumns({"bb_mid": mean("close", n), "__sd": deviation("close", n)})
    df = df.withColumns({"bb_up": F.col("bb_mid") + k * F.col("__sd"), "bb_low": F.col("bb_mid") - k * F.col("__sd")}).drop("__sd")
    span = F.col("bb_up") - F.col("bb_low")
    return df.withColumns({"bb_percent": safe(F.col("close") - F.col("bb_low"), span), "bb_width": safe(span, F.col("bb_mid"))})


@indicator("volatility")
def bollinger_population(df, n: int = 20, k: float = 2.0):
    """Mean and population deviations."""
    sd = deviation("close", n, 0)
    return df.withColumns({"bbp_up": mean("close", n) + k * sd, "bbp_low": mean("close", n) - k * sd})


@indicator("volatility")
def donchian(df, n: int = 20):
    """Highest, lowest, their middle and distance."""
    return df.withColumns({"dc_up": highest("high", n), "dc_low": lowest("low", n)}).withColumns({"dc_mid": (F.col("dc_up") + F.col("dc_low")) / 2, "dc_width": F.col("dc_up") - F.col("dc_low")})


@indicator("volatility")
def chandelier(df, n: int = 22, k: float = 3.0):
    """Highest less, and lowest plus, k mean true ranges."""
    df = stacked(df, {"__tr": true_range()}, {"__atr": mean("__tr", n)})
    return df.withColumns({"chandelier_long": highest("high", n) - k * F.col("__atr"), "chandelier_short": lowest("low", n) + k * F.col("__atr")}).drop("__tr", "__atr")


@indicator("volatility")
def choppiness(df, n: int = 14):
    """100 log(sum of true ranges / range) / log n."""
    df = df.withColumn("__tr", true_range())
    ratio = safe(total("__tr", n), highest("high", n) - lowest("low", n))
    return df.withColumn("chop", 100 * F.log10(F.when(ratio > 0, ratio)) / math.log10(n)).drop("__tr")


@indicator("volatility")
def choppiness_summed(df, n: int = 14):
    """100 log(sum of true ranges / sum of the last n ranges of n bars) / log n."""
    df = df.withColumns({"__tr": true_range(), "__range": highest("high", n) - lowest("low", n)})
    ratio = safe(total("__tr", n), total("__range", n))
    return df.withColumn("chop_summed", 100 * F.log10(F.when(ratio > 0, ratio)) / math.log10(n)).drop("__tr", "__range")


@indicator("volatility")
def realised(df, n: int = 20):
    """Deviation of returns times sqrt(n)."""
    return stacked(df, {"__r": returns("close")}, {"realised": deviation("__r", n) * math.sqrt(n)}).drop("__r")


@indicator("volatility")
def vix_fix(df, n: int = 22):
    """100 (highest close - low) / highest close."""
    return df.withColumn("vix_fix", 100 * safe(highest("close", n) - F.col("low"), highest("close", n)))


@indicator("volatility")
def spike(df, n: int = 20):
    """close - open, and its population deviation."""
    return stacked(df, {"spike": F.col("close") - F.col("open")}, {"spike_sd": deviation("spike", n, 0)})


@indicator("volatility")
def robust_z(df, n: int = 50):
    """(close - median) / (1.4826 median absolute deviation) over up to n."""
    df = df.withColumns({"__all": F.collect_list("close").over(rows(-(n - 1))), "__med": quantile("close", 0.5, n, least=1)})
    away = F.array_sort(F.transform("__all", lambda x: F.abs(x - F.col("__med"))))
    size = F.size(away)
    mad = (F.get(away, F.floor((size - 1) / 2).cast("int")) + F.get(away, F.floor(size / 2).cast("int"))) / 2
    return df.withColumn("robust_z", safe(F.col("close") - F.col("__med"), 1.4826 * mad)).drop("__all", "__med")


@indicator("volatility")
def exante_percentile(df, n: int = 100, q: float = 0.7):
    """The q-quantile of the n closes before, and the share of them not over this one."""
    w = rows(-n, -1)
    full = F.count("close").over(w) >= n
    df = df.withColumns({"exante_q": F.when(full, F.percentile("close", F.lit(q)).over(w)), "__all": F.when(full, F.collect_list("close").over(w))})
    return df.withColumn("exante_rank", F.size(F.filter("__all", lambda x: x <= F.col("close"))) / F.when(F.col("__all").isNotNull(), n)).drop("__all")


@indicator("volatility")
def stages(df, fast: int = 10, slow: int = 40, band: float = 0.1):
    """1 to 4 by the fast mean true range against the slow one: low and falling, low, high, high and rising; carried on, at first 2."""
    df = stacked(df, {"__tr": true_range()}, {"__f": mean("__tr", fast), "__s": mean("__tr", slow)}, {"__ratio": safe(F.col("__f"), F.col("__s"))})
    stage = F.when(F.col("__ratio") < 1 - band, 1).when(F.col("__ratio") < 1, 2).when(F.col("__ratio") < 1 + band, 3).when(F.col("__ratio").isNotNull(), 4)
    return stacked(df, {"__stage": stage}, {"volatility_stage": F.coalesce(carry(F.col("__stage")), F.lit(2))}).drop("__tr", "__f", "__s", "__ratio", "__stage")


# --- volume


@indicator("volume")
def obv(df):
    """1 plus the volumes of rising bars less those of falling ones."""
    return stacked(df, {"__d": F.coalesce(F.signum(change("close")) * F.col("volume"), F.lit(0.0))}, {"obv": 1 + F.sum("__d").over(so_far())}).drop("__d")


def _flow() -> Column:
    return F.coalesce(safe((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low")), F.lit(0.0)) * F.col("volume")


@indicator("volume")
def cmf(df, n: int = 20):
    """Sum of volumes weighted by the close's place in the bar, over the sum of volumes."""
    return stacked(df, {"__f": _flow()}, {"cmf": F.coalesce(safe(total("__f", n), total("volume", n)), F.when(F.count("volume").over(rows(-(n - 1))) >= n, 0.0))}).drop("__f")


@indicator("volume")
def accumulation(df):
    """Running sum of volumes weighted by the close's place in the bar; and of volumes times returns."""
    return stacked(df, {"__f": _flow(), "__p": F.coalesce(returns("close") * F.col("volume"), F.lit(0.0))}, {"ad_line": F.sum("__f").over(so_far()), "vpt": F.sum("__p").over(so_far())}).drop("__f", "__p")


@indicator("volume")
def vwap(df, n: int = 20):
    """Typical prices by volume over the last n, and so far."""
    pv = typical() * F.col("volume")
    return df.withColumns({"vwap_n": safe(total(pv, n), total("volume", n)), "vwap_all": safe(F.sum(pv).over(so_far()), F.sum("volume").over(so_far()))})


@indicator("volume")
def vwap_anchored(df, anchor: str = "day", k: float = 2.0):
    """Typical prices by volume since the anchor's start, with k deviations by volume."""
    w = Window.partitionBy("symbol", "__anchor").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__anchor": F.date_trunc(anchor, "ts"), "__tp": typical()})
    vol = F.sum("volume").over(w)
    first = safe(F.sum(F.col("__tp") * F.col("volume")).over(w), vol)
    second = safe(F.sum(F.col("__tp") * F.col("__tp") * F.col("volume")).over(w), vol)
    df = df.withColumns({"vwap_anchor": first, "__sd": F.sqrt(F.greatest(F.lit(0.0), second - first * first))})
    return df.withColumns({"vwap_up": F.col("vwap_anchor") + k * F.col("__sd"), "vwap_down": F.col("vwap_anchor") - k * F.col("__sd")}).drop("__anchor", "__tp", "__sd")


@indicator("volume")
def volume_ratio(df, n: int = 20):
    """Volume over its mean."""
    return df.withColumn("volume_ratio", safe(F.col("volume"), mean("volume", n)))


@indicator("volume")
def pvsra(df, n: int = 10):
    """2 for twice the mean volume of the bars before or the largest spread times volume, 1 for 1.5 times, else 0; by the bar's sign."""
    df = df.withColumns({"__avg": mean("volume", n, shift=1), "__effort": (F.col("high") - F.col("low")) * F.col("volume")})
    df = df.withColumn("__most", highest("__effort", n, shift=1))
    grade = F.when((F.col("volume") >= 2 * F.col("__avg")) | (F.col("__effort") >= F.col("__most")), 2).when(F.col("volume") >= 1.5 * F.col("__avg"), 1).otherwise(0)
    return df.withColumn("pvsra", grade * F.when(F.col("close") > F.col("open"), 1).otherwise(-1)).drop("__avg", "__effort", "__most")


@indicator("volume")
def liquidity_zone(df, n: int = 20, k: float = 2.0):
    """Volume over k means while the deviation is over its mean over all bars (which looks ahead)."""
    df = stacked(df, {"__sd": deviation("close", n), "__mv": mean("volume", n)}, {"__all": F.avg("__sd").over(whole())})
    return df.withColumn("liquidity_zone", F.coalesce((F.col("volume") > k * F.col("__mv")) & (F.col("__sd") > F.col("__all")), F.lit(False)).cast("int")).drop("__sd", "__mv", "__all")


# --- levels and patterns


@indicator("levels")
def pivots(df):
    """Traditional, Woodie and Camarilla levels of each bar."""
    p, r = typical(), F.col("high") - F.col("low")
    out = {"pp": p, "r1": 2 * p - F.col("low"), "s1": 2 * p - F.col("high"), "r2": p + r, "s2": p - r, "r3": F.col("high") + 2 * (p - F.col("low")), "s3": F.col("low") - 2 * (F.col("high") - p), "woodie": (F.col("high") + F.col("low") + 2 * F.col("close")) / 4}
    for n, part in enumerate((12, 6, 4), 1):
        out |= {f"camarilla_r{n}": F.col("close") + r * 1.1 / part, f"camarilla_s{n}": F.col("close") - r * 1.1 / part}
    x = F.when(F.col("close") < F.col("open"), F.col("high") + 2 * F.col("low") + F.col("close")).when(F.col("close") > F.col("open"), 2 * F.col("high") + F.col("low") + F.col("close")).otherwise(F.col("high") + F.col("low") + 2 * F.col("close"))
    return df.withColumns(out | {"dm_pivot": x / 4, "dm_r1": x / 2 - F.col("low"), "dm_s1": x / 2 - F.col("high")})


@indicator("levels")
def fibonacci(df, n: int = 50):
    """Five levels of the range of the last n."""
    top, span = highest("high", n), highest("high", n) - lowest("low", n)
    return df.withColumns({f"fib_{str(level).replace('.', '_')}": top - level * span for level in (0.236, 0.382, 0.5, 0.618, 0.786)})


@indicator("pattern")
def fair_value_gap(df, least: float = 0.0):
    """1 where the low is over the high before the last bar by more than least, -1 mirrored."""
    return df.withColumn("fvg", F.when(F.col("low") - before("high") > least, 1).when(before("low") - F.col("high") > least, -1).otherwise(0))


@indicator("pattern")
def fractals(df, k: int = 2):
    """Highs and lows that are the extremes of k bars on either side (known only k bars later)."""
    w = rows(-k, k)
    full = F.count("close").over(w) == 2 * k + 1
    return df.withColumns({"fractal_up": F.when(full & (F.col("high") == F.max("high").over(w)), 1).otherwise(0), "fractal_down": F.when(full & (F.col("low") == F.min("low").over(w)), 1).otherwise(0)})


@indicator("pattern")
def swing_labels(df, k: int = 2):
    """HH, LH, HL or LL of each pivot against the last pivot of its side (known only k bars later)."""
    df = fractals(df, k)
    df = df.withColumns({"__ph": F.when(F.col("fractal_up") == 1, F.col("high")), "__pl": F.when(F.col("fractal_down") == 1, F.col("low"))})
    w = ordered().rowsBetween(Window.unboundedPreceding, -1)
    was_h, was_l = F.last("__ph", True).over(w), F.last("__pl", True).over(w)
    label = F.when(F.col("__ph") > was_h, "HH").when(F.col("__ph").isNotNull() & was_h.isNotNull(), "LH").when(F.col("__pl") < was_l, "LL").when(F.col("__pl").isNotNull() & was_l.isNotNull(), "HL")
    return df.withColumn("swing", label).drop("__ph", "__pl")


@indicator("pattern")
def heikin_ashi_plain(df):
    """The close of four prices' mean; the open of the last bar's middle (not recursive)."""
    return df.withColumns({"ha_close": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4, "ha_open": (before("open") + before("close")) / 2})


@indicator("pattern")
def supply_demand(df, n: int = 20, k: float = 1.5):
    """1 (demand) or -1 (supply) for a close over or under its mean at k times the mean volume."""
    heavy = F.col("volume") > k * mean("volume", n)
    return df.withColumn("zone", F.when(heavy & (F.col("close") > mean("close", n)), 1).when(heavy & (F.col("close") < mean("close", n)), -1).otherwise(0))


@indicator("pattern")
def range_detector(df, n: int = 20):
    """1 where all of the last n closes lie within a mean true range of their mean."""
    df = stacked(df, {"__tr": true_range()}, {"__atr": mean("__tr", n), "__mean": mean("close", n), "__all": values("close", n)})
    return df.withColumn("in_range", F.coalesce(F.forall("__all", lambda x: F.abs(x - F.col("__mean")) <= F.col("__atr")), F.lit(False)).cast("int")).drop("__tr", "__atr", "__mean", "__all")


def volume_profile(bars: DataFrame, bins: int = 20) -> DataFrame:
    """Volume of each of so many equal price bins of a symbol, and its share; the highest price is in the last bin."""
    ends = bars.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"), F.sum("volume").alias("all"))
    # bounded: a row for each symbol, joined by key
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(safe((F.col("close") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))))
    out = bars.join(ends, "symbol").withColumn("bin", place.cast("int")).groupBy("symbol", "bin").agg(F.sum("volume").alias("volume"), F.max("all").alias("all"))
    return out.select("symbol", "bin", "volume", safe(F.col("volume"), F.col("all")).alias("share"))


# --- scores of zone classifiers, and indicators that are told apart by their formula only


def outside(x: Column | str, n: int) -> Column:
    """1 where x is over the mean and deviation of its last n, -1 where it is under mean less deviation, else 0."""
    m, s = mean(x, n), deviation(x, n)
    value = F.col(x) if isinstance(x, str) else x
    return F.when(value > m + s, 1).when(value < m - s, -1).otherwise(0)


@indicator("trend")
def adx_mixed(df, n: int = 14):
    """Directional movement with plain means, where a fall counts by its size; the first true range is null."""
    tr = F.when(before("close").isNotNull(), true_range())
    df = df.withColumns({"__u": change("high"), "__d": change("low"), "__tr": tr})
    plus = F.when((F.col("__u") > F.abs("__d")) & (F.col("__u") > 0), F.col("__u")).otherwise(0.0)
    minus = F.when((F.abs("__d") > F.col("__u")) & (F.col("__d") < 0), F.abs("__d")).otherwise(0.0)
    df = stacked(df, {"__p": plus, "__m": minus}, {"plus_di_mixed": 100 * safe(mean("__p", n), mean("__tr", n)), "minus_di_mixed": 100 * safe(mean("__m", n), mean("__tr", n))})
    dx = 100 * safe(F.abs(F.col("plus_di_mixed") - F.col("minus_di_mixed")), F.col("plus_di_mixed") + F.col("minus_di_mixed"))
    return stacked(df, {"__dx": dx}, {"adx_mixed": mean("__dx", n)}).drop("__u", "__d", "__tr", "__p", "__m", "__dx")


@indicator("trend")
def adx_clip(df, n: int = 14):
    """Directional movement where rises of the high and falls of the low both count, whichever is larger."""
    moved = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    df = df.withColumns({"__p": moved(change("high")), "__m": moved(-change("low")), "__tr": true_range()})
    df = stacked(df, {"__a": mean("__tr", n)}, {"plus_di_clip": 100 * safe(mean("__p", n), F.col("__a")), "minus_di_clip": 100 * safe(mean("__m", n), F.col("__a"))})
    dx = 100 * F.abs(F.col("plus_di_clip") - F.col("minus_di_clip")) / (F.col("plus_di_clip") + F.col("minus_di_clip") + 0.001)
    return stacked(df, {"__dx": dx}, {"adx_clip": mean("__dx", n)}).drop("__p", "__m", "__tr", "__a", "__dx")


@indicator("momentum")
def dynamic_bounds(df, n: int = 20):
    """Bounds of RSI and stochastic: mean and deviation of their last n, and which one is crossed."""
    df = stochastic(rsi_sma(df))
    named = {}
    for x, name in (("rsi", "rsi"), ("stoch_k", "stoch")):
        named |= {f"{name}_upper": mean(x, n) + deviation(x, n), f"{name}_lower": mean(x, n) - deviation(x, n), f"{name}_outside": outside(x, n)}
    return df.withColumns(named)


@indicator("pattern")
def range_place(df, n: int = 20):
    """1 near the high of the last n (the upper fifth of their range), -1 near the low, else 0."""
    place = safe(F.col("close") - lowest("low", n), highest("high", n) - lowest("low", n))
    return df.withColumn("hh_ll_score", F.when(place > 0.8, 1).when(place < 0.2, -1).otherwise(0))


@indicator("pattern")
def candle_range(df, n: int = 8):
    """Whether the bar's range is over or under the mean and deviation of the last n ranges."""
    return stacked(df, {"__r": F.col("high") - F.col("low")}, {"candle_range_score": outside("__r", n)}).drop("__r")


@indicator("volume")
def volume_score(df, n: int = 20):
    """Whether the volume is over or under the mean and deviation of the last n."""
    return df.withColumn("volume_score", outside("volume", n))


@indicator("volatility")
def damiani(df, n: int = 14):
    """Deviation of the last n returns times the square root of n."""
    return stacked(df, {"__r": returns("close")}, {"damiani": deviation("__r", n) * n**0.5}).drop("__r")


@indicator("volatility")
def waddah_attar(df, n: int = 20, k: float = 2.0, atr: int = 14):
    """1 where the close is beyond its Bollinger band and has moved by more than the mean true range, for both sides."""
    df = df.withColumns({"__m": mean("close", n), "__s": deviation("close", n), "__tr": true_range(), "__c": before("close")})
    df = df.withColumn("__a", mean("__tr", atr))
    up = (F.col("close") > F.col("__m") + k * F.col("__s")) & (F.col("close") > F.col("__c") + F.col("__a"))
    down = (F.col("close") < F.col("__m") - k * F.col("__s")) & (F.col("close") < F.col("__c") - F.col("__a"))
    return df.withColumns({"explosion_up": F.when(up, 1).otherwise(0), "explosion_down": F.when(down, 1).otherwise(0)}).drop("__m", "__s", "__tr", "__c", "__a")


@indicator("volatility")
def fractal_dimension(df, n: int = 14):
    """1 + (ln length + ln 2) / ln 2n of the path of the last n closes, but its first and last steps, in their range; 0 if flat."""
    span = highest("close", n) - lowest("close", n)
    df = df.withColumn("__span", span)
    steps = [F.abs(safe(before("close", k) - before("close", k - 1), F.col("__span")) + 1 / n**2) for k in range(1, n - 2)]
    df = df.withColumn("__length", sum(steps[1:], steps[0]))
    dimension = 1 + (F.log("__length") + math.log(2)) / math.log(2 * n)
    return df.withColumn("fdi", F.when(F.col("__span") == 0, 0.0).when(F.col("__length") > 0, dimension)).drop("__span", "__length")


@indicator("volume")
def price_entropy(df, n: int = 14):
    """Entropy in bits of the lower and the upper half of the last n closes' range, by the root of their squared volumes."""
    df = df.withColumns({"__h": highest("close", n), "__l": lowest("close", n), "__c": values("close", n), "__v": values("volume", n)})
    squares = F.zip_with("__c", "__v", lambda c, v: F.struct(((c - F.col("__l")) * 2 >= F.col("__h") - F.col("__l")).alias("up"), (v * v).alias("s")))
    half = lambda up: F.sqrt(F.aggregate(F.filter("__s", lambda x: x["up"] == up), F.lit(0.0), lambda t, x: t + x["s"]))
    df = stacked(df, {"__s": squares}, {"__a": half(True), "__b": half(False)})
    share = lambda x: safe(F.col(x), F.col("__a") + F.col("__b"))
    bits = lambda x: F.when(share(x) > 0, -share(x) * F.log2(share(x))).when(share(x) == 0, 0.0)
    return df.withColumn("entropy", F.when(F.col("__h") > F.col("__l"), bits("__a") + bits("__b"))).drop("__h", "__l", "__c", "__v", "__s", "__a", "__b")


@indicator("volume")
def volume_delta(df, n: int = 20):
    """Volume of rising and of falling bars, their difference, and its sum over the last n."""
    up, down = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    df = df.withColumns({"up_volume": F.when(up, F.col("volume")).otherwise(0.0), "down_volume": F.when(down, F.col("volume")).otherwise(0.0)})
    df = df.withColumn("volume_delta", F.col("up_volume") - F.col("down_volume"))
    return df.withColumn("volume_delta_sum", total("volume_delta", n))


@indicator("trend")
def thma(df, n: int = 16):
    """Triple Hull mean: WMA over n of 3 WMA(n / 3) - WMA(n / 2) - WMA(n)."""
    def linear(k: int) -> list[float]:
        return [i / (k * (k + 1) / 2) for i in range(1, k + 1)]

    df = df.withColumn("__raw", 3 * weighted("close", linear(n // 3)) - weighted("close", linear(n // 2)) - weighted("close", linear(n)))
    return df.withColumn("thma", weighted("__raw", linear(n))).drop("__raw")


@indicator("momentum")
def rsi_crossings(df, low: float = 30.0, high: float = 70.0):
    """1 where RSI comes up through low, -1 where it comes down through high, else 0."""
    df = rsi_sma(df)
    was = before("rsi")
    return df.withColumn("rsi_signal", F.when((was <= low) & (F.col("rsi") > low), 1).when((was >= high) & (F.col("rsi") < high), -1).otherwise(0))


def _ahead(x: str, y: str) -> Column:
    """Whether x is over (1), at (0) or under (-1) y, to nine digits."""
    return F.signum(F.round(F.col(x) - F.col(y), 9))


@indicator("momentum")
def stochastic_signals(df, n: int = 14, d: int = 3, low: float = 20.0, high: float = 80.0):
    """1 or -1 by the smoothed stochastic and its mean: where they cross; where they cross on the way out of an outer zone; which is over the other."""
    df = stacked(stochastic(df, n, d), {"__k": F.col("stoch_d")}, {"__d": mean("__k", d)}, {"__side": _ahead("__k", "__d")})
    was, k, k0 = before("__side"), F.round("__k", 9), F.round(before("__k"), 9)
    up, down = (was < 0) & (F.col("__side") > 0), (was > 0) & (F.col("__side") < 0)

    def way(long: Column, short: Column) -> Column:
        return F.when(long, 1).when(short, -1).otherwise(0)

    found = {"stoch_cross": way(up, down), "stoch_cross_zone": way(up & (k0 < low) & (k > low), down & (k0 > high) & (k < high)), "stoch_side": way(F.col("__side") > 0, F.col("__side") < 0)}
    return df.withColumns(found).drop("__k", "__d", "__side")


@indicator("volatility")
def band_oscillator(df, n: int = 20, k: float = 2.0, smooth: int = 6, trigger: int = 4):
    """The close's distance from the middle band, smoothed, against those from the outer bands: entries from within and beyond them."""
    mid, dev = mean("close", n), deviation("close", n, 0)
    far = {name: weighted(name, _linear(smooth)) for name in ("__up", "__low", "__mid")}
    df = stacked(
        df, {"__m": mid, "__s": dev},
        {name: safe(F.col("__m") + a * F.col("__s") - F.col("close"), F.col("__m") + a * F.col("__s") + F.col("close") / 2) for name, a in (("__up", k), ("__low", -k), ("__mid", 0.0))},
        far, {"band_osc": -(F.col("__mid") + mean("__mid", 2))}, {"band_osc_trigger": mean("band_osc", trigger)},
        {"__over": _ahead("band_osc", "__up"), "__under": _ahead("band_osc", "__low"), "__way": _ahead("band_osc", "band_osc_trigger")},
    )
    turn = F.when((F.col("__over") > 0) & (before("__over") <= 0), 1).when((F.col("__under") < 0) & (before("__under") >= 0), -1)
    df = stacked(df, {"__turn": turn}, {"__cycle": carry(F.col("__turn"))})
    rises, falls = F.col("__way") > 0, F.col("__way") < 0
    found = {
        "band_entry": F.when(rises & (F.col("__under") >= 0) & (F.col("__cycle") < 0), 1).when(falls & (F.col("__over") <= 0) & (F.col("__cycle") > 0), -1).otherwise(0),
        "band_exit": F.when(rises & (F.col("__over") > 0), 1).when(falls & (F.col("__under") < 0), -1).otherwise(0),
    }
    return df.withColumns(found).drop("__m", "__s", "__up", "__low", "__mid", "__over", "__under", "__way", "__turn", "__cycle")
