"""Searches over strategy parameters: all settings are scored in one pass over the bars.

A setting is a pair of means (fast, slow) or a set of signals. Each distinct mean is one window column; the settings
are then an array of positions at each bar, exploded and pre-aggregated by (symbol, setting). Settings are few and come
from the driver; bars never do.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.frames import before, mean, safe

# The default lists of the search.
FAST, SLOW = (5, 10, 20), (20, 30, 50)


def _scores(held: DataFrame, *by: str) -> DataFrame:
    """Bars in the market, trades, sum, mean and deviation of returns, and their ratio, for each setting."""
    r = F.col("__position") * F.col("__step")
    out = held.groupBy(*by).agg(F.count("*").alias("bars"), F.count_if(F.col("__position") != 0).alias("held"), F.count_if(F.col("__turn")).alias("trades"), F.sum(r).alias("total"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"))
    return out.withColumn("sharpe", F.coalesce(safe(F.col("mean"), F.col("std")), F.lit(0.0)))


def _held(bars: DataFrame, settings: list[tuple[dict, Column]], *keep: str) -> DataFrame:
    """A row for each bar and setting: its columns, the position held into the bar and the bar's step."""
    df = bars.withColumn("__step", safe(F.col("close"), before("close")) - 1)
    df = df.withColumns({f"__s{k}": F.coalesce(signal, F.lit(0)) for k, (_, signal) in enumerate(settings)})
    df = df.withColumns({f"__p{k}": F.coalesce(before(f"__s{k}"), F.lit(0)) for k in range(len(settings))})
    each = [F.struct(*[F.lit(v).alias(n) for n, v in own.items()], F.col(f"__p{k}").alias("__position"), (F.col(f"__s{k}") != F.col(f"__p{k}")).alias("__turn")) for k, (own, _) in enumerate(settings)]
    return df.where("__step is not null").select("symbol", "ts", "__step", *keep, F.inline(F.array(*each)))


def crossing_settings(fasts: tuple[int, ...] = FAST, slows: tuple[int, ...] = SLOW) -> list[tuple[dict, Column]]:
    """Long while the fast mean is over the slow one, short while under; only settings with fast < slow."""
    return [({"fast": f, "slow": s}, F.signum(F.col(f"__m{f}") - F.col(f"__m{s}")).cast("int")) for f in fasts for s in slows if f < s]


def _with_means(bars: DataFrame, settings: list[tuple[dict, Column]]) -> DataFrame:
    return bars.withColumns({f"__m{n}": mean("close", n) for n in sorted({n for own, _ in settings for n in own.values()})})


def grid(bars: DataFrame, fasts: tuple[int, ...] = FAST, slows: tuple[int, ...] = SLOW, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores of every setting per symbol; by: further columns of bars to score apart (a zone, a part of a split)."""
    settings = crossing_settings(fasts, slows)
    return _scores(_held(_with_means(bars, settings), settings, *by), "symbol", *by, "fast", "slow")


def signal_sets(bars: DataFrame, signals: dict[str, Column], sizes: tuple[int, ...] = (2, 3), least: float = 0.5) -> DataFrame:
    """Scores of every set of so many signals: 1 or -1 where their mean is over `least`, else out of the market."""
    settings = []
    for size in sizes:
        for names in combinations(sorted(signals), size):
            m = sum((signals[n] for n in names[1:]), signals[names[0]]) / size
            settings.append(({"signals": "+".join(names)}, F.when(m > least, 1).when(m < -least, -1).otherwise(0)))
    return _scores(_held(bars, settings), "symbol", "signals")


def blended(parts: DataFrame, metric: str = "sharpe", weight: float = 0.7) -> DataFrame:
    """parts (scores by part): weight * test + (1 - weight) * train, and stability 1 - |test - train| / (|test| + |train|)."""
    side = lambda p: F.max(F.when(F.col("part") == p, F.col(metric)))
    both = parts.groupBy("symbol", "fast", "slow").agg(side("train").alias("train"), side("test").alias("test")).where("train is not null and test is not null")
    return both.withColumns({"fitness": weight * F.col("test") + (1 - weight) * F.col("train"), "stability": 1 - F.coalesce(safe(F.abs(F.col("test") - F.col("train")), F.abs("test") + F.abs("train")), F.lit(0.0))})


def pareto(scores: DataFrame, by: str, *goals: str) -> DataFrame:
    """The settings that no other one of the same group is at least as good as in all goals (more is better) and better in one.

    An anti-join within each group; a group has a row for each setting, of which there are few.
    """
    a, b = scores.alias("a"), scores.select(by, *goals).alias("b")
    as_good = [F.col(f"b.{g}") >= F.col(f"a.{g}") for g in goals]
    better = [F.col(f"b.{g}") > F.col(f"a.{g}") for g in goals]
    test = F.col(f"a.{by}") == F.col(f"b.{by}")
    for x in as_good:
        test &= x
    any_better = better[0]
    for x in better[1:]:
        any_better |= x
    return a.join(b, test & any_better, "left_anti")


def stepwise(bars: DataFrame, fasts: tuple[int, ...] = FAST, slows: tuple[int, ...] = SLOW, start_slow: int | None = None) -> list[tuple[dict, float]]:
    """One parameter at a time: the best fast mean for a slow one, then the best slow mean for it; (setting, mean ratio) of each step."""
    slow, out = start_slow or max(slows), []
    for name in ("fast", "slow"):
        tried = grid(bars, fasts, (slow,)) if name == "fast" else grid(bars, (out[-1][0]["fast"],), slows)
        best = tried.groupBy("fast", "slow").agg(F.avg("sharpe").alias("s")).orderBy(F.col("s").desc(), "fast", "slow").first()
        out.append(({"fast": best["fast"], "slow": best["slow"]}, best["s"]))
    return out


def evolve(score: Callable[[list[tuple[int, ...]]], dict[tuple[int, ...], float]], ranges: list[tuple[int, int]], allowed: Callable[[tuple[int, ...]], bool], population: int = 12, generations: int = 6, elite: int = 2, mutation: float = 0.3, patience: int = 3, seed: int = 0) -> list[tuple[tuple[int, ...], float]]:
    """A genetic search over whole numbers: the best setting and score after each generation.

    score rates all new settings of a generation at once (one Spark job); what was rated is remembered. Parents win
    tournaments of 3, children take each number from either parent, and a setting that isn't allowed is drawn
    again. Without a better one for `patience` generations mutation doubles once, then the search ends.
    """
    rng, known, best = np.random.default_rng(seed), {}, []

    def draw() -> tuple[int, ...]:
        while True:
            own = tuple(int(rng.integers(a, b + 1)) for a, b in ranges)
            if allowed(own):
                return own

    def child(parents: list[tuple[int, ...]], rate: float) -> tuple[int, ...]:
        for _ in range(20):
            one, two = (max((parents[k] for k in rng.integers(0, len(parents), 3)), key=lambda p: (known[p], p)) for _ in range(2))
            own = tuple(int(rng.integers(a, b + 1)) if rng.random() < rate else (x if rng.random() < 0.5 else y) for x, y, (a, b) in zip(one, two, ranges))
            if allowed(own):
                return own
        return draw()

    now, rate, still = [draw() for _ in range(population)], mutation, 0
    for _ in range(generations):
        new = sorted({p for p in now if p not in known})
        known |= score(new) if new else {}
        now.sort(key=lambda p: (-known[p], p))
        still = still + 1 if best and known[now[0]] <= best[-1][1] else 0
        best.append((now[0], known[now[0]]))
        if still >= patience:
            if rate > mutation:
                break
            rate, still = min(1.0, 2 * mutation), 0
        now = now[:elite] + [child(now, rate) for _ in range(population - elite)]
    return best


def scored_crossings(bars: DataFrame, settings: list[tuple[int, ...]]) -> DataFrame:
    """Scores of these pairs (fast, slow) per symbol."""
    own = [({"fast": f, "slow": s}, F.signum(F.col(f"__m{f}") - F.col(f"__m{s}")).cast("int")) for f, s in settings]
    return _scores(_held(_with_means(bars, own), own), "symbol", "fast", "slow")


def evolve_crossings(bars: DataFrame, ranges: list[tuple[int, int]] = [(2, 20), (10, 60)], **kw) -> list[tuple[tuple[int, ...], float]]:
    """evolve over (fast, slow) with fast < slow, rated by the mean over symbols of return over deviation."""

    def score(settings: list[tuple[int, ...]]) -> dict[tuple[int, ...], float]:
        rated = scored_crossings(bars, settings).groupBy("fast", "slow").agg(F.avg("sharpe").alias("s"))
        return {(r["fast"], r["slow"]): r["s"] for r in rated.collect()}

    return evolve(score, ranges, lambda p: p[0] < p[1], **kw)
