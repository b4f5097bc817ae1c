"""Searches for several goals at once, and by a model of the score, over whole-number settings.

The searches hold settings and their scores, of which there are as many as were rated; `score` rates all new
settings of a round at once, as one Spark job over the bars. Nothing is rated twice. More is better in every goal.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from math import erf, prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.plans import search

Setting = tuple[int, ...]


def fronts(goals: np.ndarray) -> list[list[int]]:
    """Places of the rows by front: those that no other row beats, then those that only the first beat, and so on. A row beats
    another one if it is no worse in all goals and better in one; equal rows share a front."""
    no_worse = (goals[:, None, :] >= goals[None, :, :]).all(2)
    beats = no_worse & (goals[:, None, :] > goals[None, :, :]).any(2)
    beaten_by, left, out = beats.sum(0), np.ones(len(goals), bool), []
    while left.any():
        front = np.flatnonzero(left & (beaten_by == 0))
        out.append(front.tolist())
        left[front] = False
        beaten_by = beaten_by - beats[front].sum(0)
    return out


def crowding(goals: np.ndarray) -> np.ndarray:
    """Of each row of a front how far its neighbours lie apart, summed over the goals by their ranges; endless at the ends."""
    out = np.zeros(len(goals))
    for g in range(goals.shape[1]):
        order = np.argsort(goals[:, g], kind="stable")
        own = goals[order, g]
        out[order[[0, -1]]] = np.inf
        if own[-1] > own[0]:
            out[order[1:-1]] += (own[2:] - own[:-2]) / (own[-1] - own[0])
    return out


def nondominated(score: Callable[[list[Setting]], dict[Setting, tuple[float, ...]]], ranges: list[tuple[int, int]], allowed: Callable[[Setting], bool], population: int = 16, generations: int = 10, mutation: float = 0.3, seed: int = 0) -> list[tuple[Setting, tuple[float, ...]]]:
    """The settings that no other rated one beats, with their goals, by sorting into fronts and crowding.

    Each generation keeps the best `population` of parents and children: whole fronts first, the least crowded of the one that
    doesn't fit. Parents win tournaments of two by front, then by crowding. A child that is rated already is drawn
    anew as long as settings are easily found that aren't."""
    rng, known = np.random.default_rng(seed), {}

    def draw() -> Setting:
        for _ in range(10_000):
            own = tuple(int(rng.integers(a, b + 1)) for a, b in ranges)
            if allowed(own):
                return own
        raise ValueError("no setting is allowed")

    def ranked(pool: list[Setting]) -> list[tuple[int, float, Setting]]:
        goals = np.array([known[p] for p in pool], float)
        out = []
        for k, front in enumerate(fronts(goals)):
            apart = crowding(goals[front])
            out += sorted((k, -apart[i], pool[at]) for i, at in enumerate(front))
        return out

    def child(order: list[tuple[int, float, Setting]]) -> Setting:
        own = None
        for _ in range(20):
            one, two = (min(order[k] for k in rng.integers(0, len(order), 2))[2] for _ in range(2))
            own = tuple(int(rng.integers(a, b + 1)) if rng.random() < mutation else (x if rng.random() < 0.5 else y) for x, y, (a, b) in zip(one, two, ranges))
            if allowed(own) and own not in known:
                return own
        return draw()

    now = sorted({draw() for _ in range(population)})
    known |= score(now)
    for _ in range(generations):
        order = ranked(now)
        new = sorted({child(order) for _ in range(population)} - known.keys())
        if new:
            known |= score(new)
        now = [p for _, _, p in ranked(sorted({*now, *new}))[:population]]
    every = sorted(known)
    best = fronts(np.array([known[p] for p in every], float))[0]
    return [(every[k], known[every[k]]) for k in best]


class Surrogate:
    """A Gaussian process through the rated settings: mean and deviation of the score elsewhere. Settings are scaled to 0..1 by the
    ranges; the length of the squared-exponential kernel and the noise are the likeliest of a fixed list."""

    LENGTHS = (0.05, 0.1, 0.2, 0.4, 0.8)
    NOISES = (1e-6, 1e-3, 1e-1)

    def __init__(self, settings: list[Setting], scores: list[float], ranges: list[tuple[int, int]]):
        self.low, self.width = np.array([a for a, _ in ranges], float), np.array([max(1, b - a) for a, b in ranges], float)
        self.at, y = self._scaled(settings), np.array(scores, float)
        self.mean, self.scale = y.mean(), y.std() or 1.0
        y = (y - self.mean) / self.scale
        best = None
        for length, noise in product(self.LENGTHS, self.NOISES):
            root = np.linalg.cholesky(self._kernel(self.at, self.at, length) + noise * np.eye(len(y)))
            half = np.linalg.solve(root, y)
            likely = -0.5 * half @ half - np.log(np.diag(root)).sum()
            if best is None or likely > best[0]:
                best = likely, length, root, half
        _, self.length, self.root, self.half = best

    def _scaled(self, settings: list[Setting]) -> np.ndarray:
        return (np.array(settings, float) - self.low) / self.width

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
        return np.exp(-0.5 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / length**2)

    def at_settings(self, settings: list[Setting]) -> tuple[np.ndarray, np.ndarray]:
        part = np.linalg.solve(self.root, self._kernel(self.at, self._scaled(settings), self.length))
        mean = part.T @ self.half
        deviation = np.sqrt(np.maximum(1 - (part**2).sum(0), 1e-12))
        return self.mean + self.scale * mean, self.scale * deviation

    def improvement(self, settings: list[Setting], best: float) -> np.ndarray:
        """By how much a setting is expected to exceed best."""
        mean, deviation = self.at_settings(settings)
        z = (mean - best) / deviation
        below = np.array([0.5 * (1 + erf(x / 2**0.5)) for x in z])
        return (mean - best) * below + deviation * np.exp(-0.5 * z**2) / (2 * np.pi) ** 0.5


def modelled(score: Callable[[list[Setting]], dict[Setting, float]], ranges: list[tuple[int, int]], allowed: Callable[[Setting], bool], first: int = 8, rounds: int = 8, batch: int = 2, candidates: int = 4096, seed: int = 0) -> list[tuple[Setting, float]]:
    """The best setting and score after each round: `first` drawn ones, then `batch` a round of the greatest expected
    improvement. All settings are candidates, or `candidates` drawn anew each round where the ranges hold more.
    Within a batch a setting counts as rated by the model's mean before the next is chosen."""
    rng, known, out = np.random.default_rng(seed), {}, []

    def pool(size: int) -> list[Setting]:
        if prod(b - a + 1 for a, b in ranges) <= candidates:
            own = [p for p in product(*[range(a, b + 1) for a, b in ranges]) if allowed(p) and p not in known]
            return [own[k] for k in sorted(rng.permutation(len(own))[:size])]
        drawn = {tuple(int(x) for x in p) for p in zip(*[rng.integers(a, b + 1, size) for a, b in ranges])}
        return sorted(p for p in drawn if allowed(p) and p not in known)

    chosen = pool(first)[:first]
    if not chosen:
        raise ValueError("no setting is allowed")
    known |= score(chosen)
    for k in range(rounds + 1):
        best = min(known, key=lambda p: (-known[p], p))
        out.append((best, known[best]))
        free, guessed = pool(candidates), dict(known)
        if k == rounds or not free:
            break
        new = []
        for _ in range(min(batch, len(free))):
            model = Surrogate(list(guessed), list(guessed.values()), ranges)
            gain = model.improvement(free, max(guessed.values()))
            at = int(np.argmax(gain))
            guessed[free[at]] = float(model.at_settings([free[at]])[0][0])
            new.append(free.pop(at))
        known |= score(new)
    return out


def crossings(bars: DataFrame, settings: list[Setting]) -> dict[Setting, tuple[float, float]]:
    """Of pairs (fast, slow) of means the mean over symbols of return over deviation, and minus the trades, in one job."""
    pairs = search.scored_crossings(bars, settings).groupBy("fast", "slow").agg(F.round(F.avg("sharpe"), 9).alias("sharpe"), (-F.sum("trades")).alias("calm"))
    return {(r["fast"], r["slow"]): (r["sharpe"], float(r["calm"])) for r in pairs.collect()}
