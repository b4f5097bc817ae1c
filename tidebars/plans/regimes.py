"""Market regimes and zones of bars, and what they are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebars.functions import indicators as ind
from tidebars.functions import recurrences
from tidebars.functions.frames import before, blocked, deviation, highest, lowest, mean, ordered, quantile, returns, rows, safe, stacked
from tidebars.operators.runs import with_runs
from tidebars.operators.stats import beside, quantiles


# Weights of trend, momentum and price action by activity.
ZONE_WEIGHTS = {"High": (0.5, 0.35, 0.15), "Medium": (0.4, 0.3, 0.3), "Low": (0.25, 0.2, 0.55)}


def zone_scores(bars: DataFrame, threshold: float = 2.0, smoothing: int = 2, warm_up: int = 50) -> DataFrame:
    """Trend, momentum, price-action and activity scores, the activity state, and the zone -1, 0 or 1.

    Trend: directional movement over 20, means of 20 and 50, middles of the ranges of 9 and 26. Momentum: RSI and
    stochastic outside their bounds, MACD histogram. Price action: place in the range of 20, Heikin-Ashi body (0 if
    under a tenth of its range), bar range. Activity: band width, true range, Keltner width and volume outside
    their bounds; from 2 on it is High, from -2 down Low, and the state sets the weights. The weighted sum, as a
    mean of `smoothing` bars, gives the zone; a symbol's first warm_up bars are in zone 0.
    """
    return blocked(bars, lambda b: _zone_scores(b, threshold, smoothing, warm_up), 2048)


def _zone_scores(bars: DataFrame, threshold: float, smoothing: int, warm_up: int) -> DataFrame:
    df = recurrences.apply(bars, "macd", "heikin_ashi", "ema_family", whole=True)
    df = ind.apply(df, "adx_mixed", "dynamic_bounds", "range_place", "candle_range", "volume_score", whole=True)
    middle = lambda n: (highest("high", n) + lowest("low", n)) / 2
    body, reach = F.abs(F.col("ha_close_rec") - F.col("ha_open_rec")), F.greatest("high", "ha_open_rec", "ha_close_rec") - F.least("low", "ha_open_rec", "ha_close_rec")
    rising = F.when(F.col("ha_close_rec") > F.col("ha_open_rec"), 1).otherwise(-1)
    over = lambda test: F.when(test, 1).otherwise(-1)
    strong = F.col("adx_mixed") >= 20
    df = df.withColumns({
        "__fast": mean("close", 20), "__slow": mean("close", 50), "__a": middle(9), "__b": middle(26), "__sd": deviation("close", 20),
        "__tr": F.when(before("close").isNotNull(), ind.true_range()), "__ha": F.when(safe(body, reach) < 0.1, 0).otherwise(rising),
        "__adx": F.when(strong & (F.col("plus_di_mixed") > F.col("minus_di_mixed")), 1).when(strong & (F.col("minus_di_mixed") > F.col("plus_di_mixed")), -1).otherwise(0),
    })
    df = df.withColumn("__atr", mean("__tr", 14))
    df = df.withColumns({"__bw": 4 * safe(F.col("__sd"), F.col("__fast")), "__kw": 3 * safe(F.col("__atr"), F.col("ema_adj_20"))})
    df = df.withColumns({
        "trend_score": F.col("__adx") + over(safe(F.col("__fast") - F.col("__slow"), F.col("__slow")) > 0) + over(F.col("__a") > F.col("__b")),
        "momentum_score": F.col("rsi_outside") + F.col("stoch_outside") + over(F.col("macd_hist") > 0),
        "price_score": F.col("hh_ll_score") + F.col("__ha") + F.col("candle_range_score"),
        "activity_score": ind.outside("__bw", 20) + ind.outside("__atr", 20) + ind.outside("__kw", 20) + F.col("volume_score"),
    })
    state = F.when(F.col("activity_score") >= 2, "High").when(F.col("activity_score") <= -2, "Low").otherwise("Medium")
    df = df.withColumn("activity", state)
    weight = lambda k: F.when(F.col("activity") == "High", ZONE_WEIGHTS["High"][k]).when(F.col("activity") == "Low", ZONE_WEIGHTS["Low"][k]).otherwise(ZONE_WEIGHTS["Medium"][k])
    df = df.withColumn("__net", F.col("trend_score") * weight(0) + F.col("momentum_score") * weight(1) + F.col("price_score") * weight(2))
    df = df.withColumn("score", mean("__net", smoothing))
    zone = F.when(F.col("__row") < warm_up, 0).when(F.col("score") >= threshold, 1).when(F.col("score") <= -threshold, -1).otherwise(0)
    return df.withColumn("zone", zone).select(*bars.columns, "trend_score", "momentum_score", "price_score", "activity_score", "activity", "score", "zone")


def band_zones(bars: DataFrame, n: int = 20, k: float = 0.5) -> DataFrame:
    """1 over, -1 under, 0 within a band of k mean bar heights about a doubly smoothed close, if its slope agrees."""
    df = stacked(bars, {"__a": mean("close", n), "__h": F.col("high") - F.col("low")}, {"__mid": mean("__a", n), "__range": mean("__h", 100, least=20)}, {"__slope": F.col("__mid") - before("__mid")})
    up = (F.col("close") > F.col("__mid") + k * F.col("__range")) & (F.col("__slope") > 0)
    down = (F.col("close") < F.col("__mid") - k * F.col("__range")) & (F.col("__slope") < 0)
    return df.withColumn("zone", F.when(up, 1).when(down, -1).otherwise(0)).drop("__a", "__h", "__mid", "__range", "__slope")


def rule_regimes(bars: DataFrame, n: int = 100) -> DataFrame:
    """The first of ordered rules that holds, on quantiles of the n bars before."""
    return blocked(bars, lambda b: _rule_regimes(b, n), 2 * ind.LOOKBACK + n)


def _rule_regimes(bars: DataFrame, n: int) -> DataFrame:
    df = ind.apply(bars, "adx_sma", "realised", "rsi_sma", whole=True)
    df = df.withColumns({"__hot": quantile("realised", 0.8, n, shift=1, least=20), "__calm": quantile("realised", 0.2, n, shift=1, least=20), "__m": mean("close", 50)})
    trending, hot, calm = F.col("adx_sma") > 25, F.col("realised") > F.col("__hot"), F.col("realised") < F.col("__calm")
    up = F.col("close") > F.col("__m")
    regime = (
        F.when(F.col("__m").isNull() | F.col("adx_sma").isNull(), "unknown").when(hot & trending & up, "volatile_up").when(hot & trending, "volatile_down").when(hot, "volatile_range")
        .when(trending & up & (F.col("rsi") > 70), "overbought_up").when(trending & ~up & (F.col("rsi") < 30), "oversold_down").when(trending & up, "up").when(trending, "down").when(calm, "calm").otherwise("range")
    )
    return df.withColumn("regime", regime).drop("__hot", "__calm", "__m")


def price_action_zones(bars: DataFrame) -> DataFrame:
    """Primary zone by the last bar against the two before it; secondary by its close against the range of 10 (all known before this bar)."""
    c1, c2, c3 = (before("close", k) for k in (1, 2, 3))
    primary = F.when((c1 > c2) & (c2 > c3), 1).when((c1 < c2) & (c2 < c3), -1).otherwise(0)
    df = bars.withColumns({"__hh": highest("high", 10, shift=2), "__ll": lowest("low", 10, shift=2), "primary": primary, "__c1": c1})
    return df.withColumn("secondary", F.when(F.col("__c1") > F.col("__hh"), 2).when(F.col("__c1") < F.col("__ll"), -2).otherwise(0)).drop("__hh", "__ll", "__c1")


def segments(bars: DataFrame, n: int = 24, step: int = 12, slope_jump: float = 0.5, offset_jump: float = 20.0) -> DataFrame:
    """bars with a segment number: a new one begins where the line through the last n closes, looked at every
    `step` bars, turns by more than slope_jump or moves by more than offset_jump from the look before."""
    df = bars.withColumn("__i", F.row_number().over(ordered()).cast("double"))
    w = rows(-(n - 1))
    full = F.count("close").over(w) >= n
    df = df.withColumns({"__slope": F.when(full, F.regr_slope("close", "__i").over(w)), "__at": F.when(full, F.avg("close").over(w))})
    look = full & (F.col("__i").cast("long") % step == 0)
    df = df.withColumn("__look", F.when(look, F.struct(F.col("__slope").alias("s"), F.col("__at").alias("m"))))
    last = F.last("__look", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__last", last)
    turned = (F.abs(F.col("__look.s") - F.col("__last.s")) > slope_jump) | (F.abs(F.col("__look.m") - F.col("__last.m")) > offset_jump)
    df = df.withColumn("__cut", F.when(turned, 1).otherwise(0))
    return df.withColumn("segment", F.sum("__cut").over(ordered().rowsBetween(Window.unboundedPreceding, 0))).drop("__i", "__slope", "__at", "__look", "__last", "__cut")


def segment_matrix(bars: DataFrame, lone_slope: float | None = None) -> DataFrame:
    """A row for each segment: bounds, prices, slope, volatility and volume, and their classes. bars: segment.

    A segment with a single close has no line; its slope is lone_slope (null: flat; NaN, as in DuckDB, is over any number: up).
    """
    df = bars.withColumns({"__i": F.row_number().over(ordered()).cast("double"), "__r": returns("close")})
    out = df.groupBy("symbol", "segment").agg(
        F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("bars"), F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.when(F.count("close") == 1, F.lit(lone_slope).cast("double")).otherwise(F.regr_slope("close", "__i")).alias("slope"), F.stddev_samp("__r").alias("volatility"), F.sum("volume").alias("volume"), F.avg("volume").alias("mean_volume"),
    )
    out = out.withColumn("change_pct", 100 * safe(F.col("close") - F.col("open"), F.col("open")))
    all_of = Window.partitionBy("symbol")
    out = out.withColumns({"__v": F.percentile("volatility", F.lit(0.5)).over(all_of), "__m": F.percentile("mean_volume", F.lit(0.5)).over(all_of)})

    def ladder(x: str, middle: str) -> Column:
        ratio = safe(F.col(x), F.col(middle))
        return F.when(ratio > 1.5, "high").when(ratio < 0.67, "low").otherwise("medium")

    direction = F.when(F.col("slope") > 0.1, "up").when(F.col("slope") < -0.1, "down").otherwise("flat")
    out = out.withColumns({"direction": direction, "volatility_class": ladder("volatility", "__v"), "volume_class": ladder("mean_volume", "__m")}).drop("__v", "__m")
    return out.withColumn("zone_id", F.concat_ws("_", "direction", "volatility_class", "volume_class"))


def fingerprints(bars: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """For each label and indicator: min, max, median, mean, deviation, quartiles and count."""
    long = bars.select(label, *columns).unpivot([label], columns, "indicator", "value").where("value is not null")
    keys = [label, "indicator"]
    plain = {"min": F.min("value"), "max": F.max("value"), "mean": F.avg("value"), "std": F.stddev_samp("value"), "count": F.count("value")}
    out = beside(long.groupBy(*keys).agg(*[e.alias(n) for n, e in plain.items()]), quantiles(long, keys, "value", {"median": 0.5, "p25": 0.25, "p75": 0.75}), keys)
    return out.select(*keys, "min", "max", "median", "mean", "std", "p25", "p75", "count")


def match_fingerprints(bars: DataFrame, prints: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """bars with `matched`: the label whose quartile ranges hold most of the row's indicators (ties: nearer medians, then the name).

    prints has a row for each of a few labels and indicators, so it is broadcast.
    """
    long = bars.select("symbol", "ts", *columns).unpivot(["symbol", "ts"], columns, "indicator", "value").where("value is not null")
    near = safe(F.abs(F.col("value") - F.col("median")), F.col("std"))
    hit = F.when(F.col("value").between(F.col("p25"), F.col("p75")), 1.0).otherwise(0.0)
    scored = long.join(F.broadcast(prints), "indicator").groupBy("symbol", "ts", label).agg(F.sum(hit).alias("hits"), F.round(F.sum(F.coalesce(near, F.lit(0.0))), 9).alias("away"))
    best = scored.groupBy("symbol", "ts").agg(F.min(F.struct((-F.col("hits")).alias("h"), "away", label)).alias("b"))
    return best.select("symbol", "ts", F.col(f"b.{label}").alias("matched"))


def durations(bars: DataFrame, label: str) -> DataFrame:
    """For each label: its runs and their mean and longest length."""
    runs = with_runs(bars, label).groupBy("symbol", "run", label).count()
    return runs.groupBy(label).agg(F.count("*").alias("runs"), F.avg("count").alias("mean_length"), F.max("count").alias("longest"))


def economic_value(bars: DataFrame, label: str) -> DataFrame:
    """For each label: share of bars, and mean, deviation and sum of the next bar's return."""
    nexts = bars.withColumn("__next", safe(before("close", -1), F.col("close")) - 1)
    out = nexts.groupBy(label).agg(F.count("*").alias("bars"), F.avg("__next").alias("mean_return"), F.stddev_samp("__next").alias("std_return"), F.sum("__next").alias("sum_return"))
    return out.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy()))


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    return bars.withColumns({f"forward_{h}": safe(before("close", -h), F.col("close")) - 1 for h in horizons})


def stability(bars: DataFrame, label: str) -> DataFrame:
    """For each symbol: changes of the label (the first bar counts) and one less their share of bars."""
    moved = F.when(before(label).eqNullSafe(F.col(label)) & before(label).isNotNull(), 0).otherwise(1)
    out = bars.withColumn("__moved", moved).groupBy("symbol").agg(F.sum("__moved").alias("changes"), F.count("*").alias("bars"))
    return out.withColumn("stability", 1 - F.col("changes") / F.col("bars"))
