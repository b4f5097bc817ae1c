"""Statistics of tables and of labelled bars: counts, shares, spreads and scores, as a few aggregations each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebars.functions.frames import before, rows, safe


def crosstab(table: DataFrame, a: str, b: str) -> DataFrame:
    """How often each pair of values occurs, and its share of its first value's rows."""
    counts = table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def transition_shares(bars: DataFrame, label: str) -> DataFrame:
    """crosstab of each bar's label (was) with the next one's (now)."""
    return crosstab(bars.select(before(label).alias("was"), F.col(label).alias("now")), "was", "now")


def value_shares(table: DataFrame, x: str) -> DataFrame:
    """Each value's count and share of all rows; the total is joined, so that no window holds the whole table."""
    counts = table.groupBy(x).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__all"))), how="cross").withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def most_frequent(table: DataFrame, by: str, x: str) -> DataFrame:
    """The commonest value of x in each group, of equally common ones the least."""
    counts = table.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(x).alias("x"))).alias("b")).select(by, F.col("b.x").alias(x), (-F.col("b.m")).alias("n"))


def correlations(table: DataFrame, by: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson's correlation of each pair of columns in each group."""
    return table.groupBy(by).agg(*[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs])


def metric_trends(metrics: DataFrame, order: str, names: list[str]) -> DataFrame:
    """For each metric: mean, deviation, stability 1 / (1 + deviation / |mean|) and slope by order."""
    long = metrics.unpivot([order], names, "metric", "value")
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.regr_slope(F.col("value"), F.col(order).cast("double")).alias("trend"), F.count("value").alias("n"))
    return out.withColumn("stability", 1 / (1 + F.coalesce(safe(F.col("std"), F.abs(F.col("mean"))), F.lit(0.0))))


#: Approximate quantiles that lead to exact ones err by at most a row in so many.
NEAR = 1000


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the columns of right, which is broadcast; null keys are equal."""
    named = right.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    return left.join(F.broadcast(named), same, how).drop(*[f"__of_{k}" for k in keys])


def quantiles(table: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """A row for each group with exact quantiles of x (name: share), interpolated as percentile does it.

    Approximate quantiles around each share cut a group into buckets. Their counts tell which of them hold the wanted ranks, and
    only the values of those are counted one by one and put in order, so that no task holds more than a small part of a group. Where
    the cuts lie decides the work, never the result. A group's cuts and counts are broadcast.
    """
    near = sorted({min(1.0, max(0.0, q + d)) for q in shares.values() for d in (-2 / NEAR, 2 / NEAR)})
    values = table.select(*by, F.col(x).cast("double").alias("__x"))
    cuts = values.groupBy(*by).agg(F.percentile_approx(F.when(~F.isnan("__x"), F.col("__x")), F.array(*[F.lit(q) for q in near]), F.lit(NEAR)).alias("__cuts"))
    over = [F.coalesce((F.col("__x") > F.col("__cuts")[k]).cast("int"), F.lit(0)) for k in range(len(near))]
    placed = beside(values.where("__x is not null"), cuts, by).select(*by, "__x", sum(over[1:], over[0]).alias("__bucket"))
    group = Window.partitionBy(*by)
    sizes = placed.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumns({"__all": F.sum("__n").over(group), "__start": F.sum("__n").over(group.orderBy("__bucket")) - F.col("__n")})
    at = {name: F.lit(q) * (F.col("__all") - 1) for name, q in shares.items()}
    ranks = [edge(p) for p in at.values() for edge in (F.floor, F.ceil)]
    held = [(r >= F.col("__start")) & (r < F.col("__start") + F.col("__n")) for r in ranks]
    chosen = sizes.where(reduce(Column.__or__, held)).drop("__n")
    each = beside(placed, chosen, [*by, "__bucket"]).groupBy(*by, "__bucket", "__all", "__start", "__x").agg(F.count("*").alias("__n"))
    each = each.withColumn("__end", F.col("__start") + F.sum("__n").over(Window.partitionBy(*by, "__bucket").orderBy("__x")))
    low, high = ({n: F.min(F.when(F.col("__end") > edge(p), F.col("__x"))).alias(f"__{side}_{n}") for n, p in at.items()} for side, edge in (("low", F.floor), ("high", F.ceil)))
    found = each.groupBy(*by, "__all").agg(*low.values(), *high.values())

    def between(name: str) -> Column:
        a, b, p = F.col(f"__low_{name}"), F.col(f"__high_{name}"), at[name]
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)

    return beside(cuts.select(*by), found.select(*by, *[between(n).alias(n) for n in shares]), by, "left")


def describe(table: DataFrame, *columns: str) -> DataFrame:
    """A row for each column: count, nulls, mean, std, min, quartiles and max."""
    long = table.select(*[F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "column", "value")
    out = long.groupBy("column").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("nulls"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return beside(out, quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), ["column"]).select("column", "count", "nulls", "mean", "std", "min", "p25", "p50", "p75", "max")


def nulls(table: DataFrame, *columns: str) -> DataFrame:
    """A row for each column: nulls, NaNs among doubles, and the share of either."""
    kinds = dict(table.dtypes)
    marks = [F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("null"), (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)).alias("nan")) for c in columns]
    each = table.select(F.explode(F.array(*marks)).alias("m")).groupBy("m.column").agg(F.count_if("m.null").alias("nulls"), F.count_if("m.nan").alias("nans"), F.count("*").alias("__n"))
    return each.select("column", "nulls", "nans", ((F.col("nulls") + F.col("nans")) / F.col("__n")).alias("share"))


def coverage(bars: DataFrame, x: str, by: str = "symbol") -> DataFrame:
    """Bars, those with a value of x, and their share."""
    return bars.groupBy(by).agg(F.count("*").alias("bars"), F.count(x).alias("covered")).withColumn("coverage", F.col("covered") / F.col("bars"))


def global_quantiles(bars: DataFrame, x: str, shares: list[float], by: str = "symbol") -> DataFrame:
    """Quantiles of x over each symbol's whole history, as <x>_q<percent>."""
    return quantiles(bars, [by], x, {f"{x}_q{round(100 * q)}": q for q in shares})


def label_economics(bars: DataFrame, label: str) -> DataFrame:
    """Per symbol, of each bar's own return by its label 1, -1 or 0: mean and deviation of each side, return spread,
    trend efficiency (share of labels other than 0 whose sign the return has), persistence, volatility separation
    and economic value |bull - bear| / (1 + deviation of the 0 side)."""
    df = bars.withColumns({"__r": safe(F.col("close"), before("close")) - 1, "__was": before(label)})
    sides = {"bull": 1, "bear": -1, "side": 0}
    of = lambda f, k: F.coalesce(f(F.when(F.col(label) == k, F.col("__r"))), F.lit(0.0))
    right = ((F.col(label) == 1) & (F.col("__r") > 0)) | ((F.col(label) == -1) & (F.col("__r") < 0))
    out = df.where("__r is not null").groupBy("symbol").agg(
        *[of(F.avg, k).alias(f"{n}_return") for n, k in sides.items()], *[of(F.stddev_samp, k).alias(f"{n}_std") for n, k in sides.items()],
        F.count_if(right).alias("__right"), F.count_if(F.col(label) != 0).alias("__trend"), F.count_if(F.col("__was") == F.col(label)).alias("__same"), F.count("*").alias("bars"),
    )
    return out.select(
        "symbol", "bars", *[f"{n}_{x}" for n in sides for x in ("return", "std")], (F.col("bull_return") - F.col("bear_return")).alias("return_spread"),
        F.coalesce(safe(F.col("__right"), F.col("__trend")), F.lit(0.0)).alias("trend_efficiency"), (F.col("__same") / F.col("bars")).alias("persistence"),
        (F.greatest("bull_std", "bear_std", "side_std") - F.least("bull_std", "bear_std", "side_std")).alias("volatility_separation"), (F.abs(F.col("bull_return") - F.col("bear_return")) / (1 + F.col("side_std"))).alias("economic_value"),
    )


def separation(bars: DataFrame, label: str, x: str) -> DataFrame:
    """Per symbol the largest less the least mean of x by label."""
    means = bars.groupBy("symbol", label).agg(F.avg(x).alias("m"))
    return means.groupBy("symbol").agg((F.max("m") - F.min("m")).alias("separation"), F.count("*").alias("labels"))


def switching(bars: DataFrame, label: str, uncertain: object) -> DataFrame:
    """Per symbol: label changes in 1000 bars and the share of bars with the label `uncertain`."""
    moved = F.when(before(label).isNotNull() & (before(label) != F.col(label)), 1).otherwise(0)
    out = bars.withColumn("__moved", moved).groupBy("symbol").agg(F.sum("__moved").alias("switches"), F.count_if(F.col(label) == uncertain).alias("__u"), F.count("*").alias("bars"))
    return out.select("symbol", "bars", "switches", (1000 * F.col("switches") / F.col("bars")).alias("switches_per_1000"), (F.col("__u") / F.col("bars")).alias("uncertain_share"))


def event_study(bars: DataFrame, event: Column, falls: bool, window: int = 10) -> DataFrame:
    """Over all events: their number, mean and median growth of the close within the next `window` bars, and the share
    whose growth has the wrong sign (falls: it should go down). The last bars' windows end with the history."""
    end = F.last("close").over(rows(1, window))
    df = bars.withColumns({"__event": event, "__growth": F.coalesce(safe(end, F.col("close")) - 1, F.lit(0.0))}).where("__event")
    wrong = F.col("__growth") > 0 if falls else F.col("__growth") < 0
    out = df.agg(F.count("*").alias("events"), F.avg("__growth").alias("mean_growth"), safe(F.count_if(wrong), F.count("*")).alias("false_rate"))
    median = quantiles(df.withColumn("__whole", F.lit(0)), ["__whole"], "__growth", {"median_growth": 0.5})
    return out.join(F.broadcast(median), how="left", on=F.lit(True)).select("events", "mean_growth", "median_growth", "false_rate")


def capacity(bars: DataFrame, label: str, sizes: list[float], impact: float = 0.001) -> DataFrame:
    """Per symbol and position size: mean and deviation of the held label's return less size * impact * label."""
    df = bars.withColumns({"__r": safe(F.col("close"), before("close")) - 1, "__p": before(label)}).where("__r is not null and __p is not null")
    each = df.withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    net = F.col("__p") * F.col("__r") - F.abs("__p") * F.col("size") * impact
    return each.groupBy("symbol", "size").agg(F.avg(net).alias("mean_return"), F.stddev_samp(net).alias("std_return"), F.count("*").alias("bars"))


def composite(metrics: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """metrics with the weighted sum of their columns, each held within 0 and 1 (null counts as 0)."""
    parts = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)))) * w for c, w in weights.items()]
    return metrics.withColumn(name, sum(parts[1:], parts[0]))


def trade_sharpe(trades: DataFrame, gain: str = "pnl_pct", periods: float = 252 * 24 * 4) -> DataFrame:
    """Per symbol: trades, win rate, mean gain, profit factor and mean / population deviation * sqrt(periods)."""
    g = F.col(gain)
    return trades.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.avg(F.when(g > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(g).alias("mean_gain"),
        safe(F.sum(F.when(g > 0, g).otherwise(0.0)), -F.sum(F.when(g < 0, g).otherwise(0.0))).alias("profit_factor"), (safe(F.avg(g), F.stddev_pop(g)) * periods**0.5).alias("sharpe"),
    )
