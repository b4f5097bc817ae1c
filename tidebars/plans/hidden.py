"""Hidden Markov models with independent normal features, over whole sequences cut into blocks.

A sequence's forward pass is a product of k x k matrices, one a row. Each block of rows multiplies its
own matrices (rows kept at sum 1, their logarithms apart); a scan over the few block products of a
sequence gives the vector that enters each block from the left and from the right; a second pass over
the blocks gives each row's state probabilities, as if the sequence had been walked from end to end.
Within a block the same is done with chunks, whose rows are walked side by side. The likeliest path is
the same with maxima in place of sums: the scan fixes the states at the borders of the blocks, and each
block finds its own part between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.plans.graph import settle

#: Rows of a block, and of a chunk within it.
BLOCK_ROWS = 32768
CHUNK = 128
_TINY = 1e-300


@dataclass(frozen=True)
class States:
    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    loglik: float = float("nan")
    rows: int = 0

    @property
    def bic(self) -> float:
        k, d = self.means.shape
        return -2 * self.loglik + (k * k - 1 + 2 * k * d) * float(np.log(max(self.rows, 1)))

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        away = (x[:, None, :] - self.means) ** 2 / self.variances + np.log(2 * np.pi * self.variances)
        return -0.5 * away.sum(axis=2)


def _chunks(log_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Densities as (chunk, row, state), each row's largest set to 1; the rows of each chunk; the logarithms taken out."""
    n, k = log_b.shape
    m = -(-n // CHUNK)
    peak = log_b.max(axis=1)
    b = np.ones((m * CHUNK, k))
    b[:n] = np.exp(log_b - peak[:, None])
    return b.reshape(m, CHUNK, k), np.minimum(CHUNK, n - CHUNK * np.arange(m)), float(peak.sum())


def _products(b: np.ndarray, rows: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """D0 A D1 A ... of each chunk: rows of sum 1, and their logarithms."""
    k = b.shape[2]
    q = np.eye(k) * b[:, 0, None, :]
    total = np.maximum(q.sum(axis=2), _TINY)
    q, s = q / total[:, :, None], np.log(total)
    for t in range(1, b.shape[1]):
        new = (q @ moves) * b[:, t, None, :]
        total = np.maximum(new.sum(axis=2), _TINY)
        on = t < rows
        q = np.where(on[:, None, None], new / total[:, :, None], q)
        s = s + np.where(on[:, None], np.log(total), 0.0)
    return q, s


def _forward(q: np.ndarray, s: np.ndarray, model: States, entry: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
    """The state probabilities before each product's first row (moves applied), those at the end of the last, and the log-likelihood."""
    before, loglik = np.empty((len(q), q.shape[1])), 0.0
    for j in range(len(q)):
        before[j] = model.start if entry is None else entry @ model.moves
        w = np.log(np.maximum(before[j], _TINY)) + s[j]
        top = w.max()
        a = np.exp(w - top) @ q[j]
        total = max(a.sum(), _TINY)
        loglik += top + np.log(total)
        entry = a / total
    return before, entry, loglik


def _backward(q: np.ndarray, s: np.ndarray, model: States, end: np.ndarray) -> np.ndarray:
    """What follows each product's last row, for each state, up to a factor."""
    after = np.empty((len(q), q.shape[1]))
    for j in range(len(q) - 1, -1, -1):
        after[j] = end
        r = s[j] + np.log(np.maximum(q[j] @ end, _TINY))
        end = model.moves @ np.exp(r - r.max())
        end = end / end.max()
    return after


def block_product(x: np.ndarray, model: States) -> tuple[np.ndarray, np.ndarray]:
    """The product of a block's matrices: rows of sum 1, and their logarithms."""
    b, rows, taken = _chunks(model.log_densities(x))
    q, s = _products(b, rows, model.moves)
    out, log_out = q[0], s[0] + taken
    for j in range(1, len(q)):
        r = np.log(np.maximum(out @ model.moves, _TINY))[:, :, None] + s[j][None, :, None] + np.log(np.maximum(q[j], _TINY))[None]
        top = r.max(axis=(1, 2))
        new = np.exp(r - top[:, None, None]).sum(axis=1)
        total = new.sum(axis=1)
        out, log_out = new / total[:, None], log_out + top + np.log(total)
    return out, log_out


def smooth(x: np.ndarray, model: States, entry: np.ndarray | None, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of a block's rows and the expected moves into them; entry: probabilities at the row before (None: none)."""
    b, rows, _ = _chunks(model.log_densities(x))
    m, length, k = b.shape
    q, s = _products(b, rows, model.moves)
    before, _, _ = _forward(q, s, model, entry)
    after = _backward(q, s, model, end)
    alpha, beta = np.empty_like(b), np.empty_like(b)
    now = before
    for t in range(length):
        a = now * b[:, t]
        alpha[:, t] = a / np.maximum(a.sum(axis=1, keepdims=True), _TINY)
        now = alpha[:, t] @ model.moves
    back = after
    for t in range(length - 1, -1, -1):
        beta[:, t] = np.where((t == rows - 1)[:, None], after, back)
        back = (b[:, t] * beta[:, t]) @ model.moves.T
        back = back / np.maximum(back.max(axis=1, keepdims=True), _TINY)
    n = int(rows.sum())
    alpha, beta, b = (v.reshape(m * length, k)[:n] for v in (alpha, beta, b))
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), _TINY)
    came = np.concatenate([np.zeros((1, k)) if entry is None else entry[None], alpha[:-1]])
    into = b * beta
    weight = np.einsum("ti,ij,tj->t", came, model.moves, into)
    came = came / np.where(weight > 0, weight, 1.0)[:, None]
    return gamma, model.moves * (came.T @ into)


def best_product(x: np.ndarray, model: States) -> np.ndarray:
    """The best log weight of a path through the block from each first to each last state."""
    log_b, log_moves = model.log_densities(x), np.log(np.maximum(model.moves, _TINY))
    b = log_b[: len(x) // CHUNK * CHUNK].reshape(-1, CHUNK, log_b.shape[1])
    parts = []
    if len(b):
        p = np.where(np.eye(log_b.shape[1], dtype=bool), b[:, 0, None, :], -np.inf)
        for t in range(1, CHUNK):
            p = (p[:, :, :, None] + log_moves).max(axis=2) + b[:, t, None, :]
        parts = list(p)
    out = None
    for p in parts:
        out = p if out is None else ((out[:, :, None] + log_moves).max(axis=1)[:, :, None] + p).max(axis=1)
    for row in log_b[len(b) * CHUNK :]:
        out = np.where(np.eye(len(row), dtype=bool), row, -np.inf) if out is None else (out[:, :, None] + log_moves).max(axis=1) + row
    return out


def best_path(x: np.ndarray, model: States, came: int | None, last: int) -> np.ndarray:
    """The best path through the block that comes from state `came` (None: the start) and ends in `last`; ties to the lower state."""
    log_b, log_moves = model.log_densities(x), np.log(np.maximum(model.moves, _TINY))
    best = (np.log(np.maximum(model.start, _TINY)) if came is None else log_moves[came]) + log_b[0]
    back = np.empty(log_b.shape, np.int32)
    for t in range(1, len(x)):
        every = best[:, None] + log_moves
        back[t] = every.argmax(axis=0)
        best = every.max(axis=0) + log_b[t]
    path = np.empty(len(x), np.int32)
    path[-1] = last
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


# --- over Spark


def blocks(bars: DataFrame, columns: list[str], key: str = "symbol", time: str = "ts", rows: int | None = None) -> DataFrame:
    """(symbol, block, times, data): the rows without nulls in columns, in time order, packed by blocks; row numbers come from counts of days."""
    ready = bars.select(F.col(key).alias("symbol"), F.col(time).alias("ts"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).where(F.col(key).isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    counted = ready.withColumn("day", F.to_date("ts"))
    days = counted.groupBy("symbol", "day").count()
    starts = days.withColumn("first", F.sum("count").over(Window.partitionBy("symbol").orderBy("day")) - F.col("count")).drop("count")
    numbered = counted.join(starts, ["symbol", "day"]).withColumn("row", F.col("first") + F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts", "x")) - 1)
    packed = numbered.groupBy("symbol", F.floor(F.col("row") / (rows or BLOCK_ROWS)).alias("block")).agg(F.array_sort(F.array_agg(F.struct("row", "ts", "x"))).alias("r"))
    return packed.select("symbol", "block", F.transform("r", lambda r: r["ts"]).alias("times"), F.flatten(F.transform("r", lambda r: r["x"])).alias("data"))


def _by_block(packed: DataFrame, run, schema: str, extra: tuple = ()) -> DataFrame:
    """run(x, *extra columns) of each block gives columns of equal length; symbol and block are added."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                yield pd.DataFrame({"symbol": r.symbol, "block": r.block} | dict(zip(names, run(np.asarray(r.data, float), *(getattr(r, c) for c in extra)))))

    return packed.select("symbol", "block", "data", *extra).mapInPandas(each, f"symbol string, block long, {schema}")


def _borders(packed: DataFrame, model: States, d: int) -> DataFrame:
    """(symbol, block, entry, following, loglik): what enters each block from both sides; loglik is the sequence's, on its first block."""

    def product(data):
        q, s = block_product(data.reshape(-1, d), model)
        return [q.ravel().tolist()], [s.tolist()]

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        k = len(model.start)
        q, s = np.array(rows["q"].tolist()).reshape(-1, k, k), np.array(rows["s"].tolist())
        entry, entries, loglik = None, [], 0.0
        for j in range(len(q)):
            entries.append(None if entry is None else entry.tolist())
            _, entry, more = _forward(q[j : j + 1], s[j : j + 1], model, entry)
            loglik += more
        return pd.DataFrame({"symbol": rows["symbol"], "block": rows["block"], "entry": entries, "following": _backward(q, s, model, np.ones(k)).tolist(), "loglik": np.where(np.arange(len(q)) == 0, loglik, 0.0)})

    found = _by_block(packed, product, "q array<double>, s array<double>")
    return found.groupBy("symbol").applyInPandas(scan, "symbol string, block long, entry array<double>, following array<double>, loglik double")


def _with_borders(packed: DataFrame, model: States, d: int) -> DataFrame:
    return packed.join(_borders(packed, model, d), ["symbol", "block"])


def _sums(packed: DataFrame, model: States, d: int) -> np.ndarray:
    """Added up over all blocks: first states, moves, weights, weighted values and squares, log-likelihood."""

    def sums(data, entry, following, loglik):
        x = data.reshape(-1, d)
        gamma, moves = smooth(x, model, None if entry is None else np.asarray(entry), np.asarray(following))
        parts = [gamma[0] if entry is None else np.zeros(gamma.shape[1]), moves.ravel(), gamma.sum(axis=0), (gamma.T @ x).ravel(), (gamma.T @ x**2).ravel(), [loglik]]
        values = np.concatenate(parts)
        return np.arange(len(values)), values

    found = _by_block(_with_borders(packed, model, d), sums, "at int, value double", ("entry", "following", "loglik"))
    return found.groupBy("at").agg(F.sum("value").alias("v")).orderBy("at").toPandas()["v"].to_numpy()


def fit(bars: DataFrame, columns: list[str], k: int, passes: int = 20, tolerance: float = 1e-4, block_rows: int | None = None) -> States:
    """Baum-Welch over whole sequences; starts at quantiles of the first column. States go up with the first column's mean."""
    d = len(columns)
    packed = settle(blocks(bars, columns, rows=block_rows), "sequences")
    each = packed.select(F.size("times").alias("n"), *[F.transform(F.sequence(F.lit(0), F.size("times") - 1), _column(c, d)).alias(f"x{c}") for c in range(d)])
    flat = each.select(F.explode(F.arrays_zip(*[f"x{c}" for c in range(d)])).alias("z")).select("z.*")
    first = flat.agg(F.percentile_approx("x0", F.array(*[F.lit((i + 0.5) / k) for i in range(k)]), F.lit(10_000)).alias("q"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *[F.var_pop(f"x{i}").alias(f"v{i}") for i in range(d)], F.count("*").alias("n")).first()
    if not first["n"]:
        raise ValueError("no rows without nulls")
    means = np.tile([first[f"m{i}"] for i in range(d)], (k, 1))
    means[:, 0] = first["q"]
    variances = np.tile([max(first[f"v{i}"], 1e-12) for i in range(d)], (k, 1))
    least = 1e-6 * variances[0]
    s = States(np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), means, variances, -np.inf, first["n"])
    for _ in range(passes):
        start, moves, weight, one, two, loglik = np.split(_sums(packed, s, d), np.cumsum([k, k * k, k, k * d, k * d]))
        mean = one.reshape(k, d) / np.maximum(weight, 1e-12)[:, None]
        variance = np.maximum(two.reshape(k, d) / np.maximum(weight, 1e-12)[:, None] - mean**2, least)
        moves = moves.reshape(k, k) + 1e-12
        done = abs(loglik[0] - s.loglik) <= tolerance * max(1.0, abs(loglik[0]))
        s = States(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), mean, variance, float(loglik[0]), s.rows)
        if done:
            break
    order = np.argsort(s.means[:, 0], kind="stable")
    return States(s.start[order], s.moves[order][:, order], s.means[order], s.variances[order], s.loglik, s.rows)


def _column(c: int, d: int):
    return lambda i: F.get("data", i * d + c)


def log_likelihood(bars: DataFrame, model: States, columns: list[str], block_rows: int | None = None) -> float:
    return float(_borders(blocks(bars, columns, rows=block_rows), model, len(columns)).agg(F.sum("loglik")).first()[0] or 0.0)


def probabilities(bars: DataFrame, model: States, columns: list[str], block_rows: int | None = None) -> DataFrame:
    """symbol, ts, and the probabilities of the states at each row given its whole sequence."""
    d = len(columns)

    def run(data, times, entry, following):
        gamma, _ = smooth(data.reshape(-1, d), model, None if entry is None else np.asarray(entry), np.asarray(following))
        return list(times), gamma.tolist()

    packed = settle(blocks(bars, columns, rows=block_rows), "sequences")
    kind = bars.schema["ts"].dataType.simpleString()
    return _by_block(_with_borders(packed, model, d), run, f"ts {kind}, chance array<double>", ("times", "entry", "following")).drop("block")


def states(bars: DataFrame, model: States, columns: list[str], block_rows: int | None = None) -> DataFrame:
    """bars without nulls in columns, with `state`: that of the likeliest path through each sequence. (symbol, ts) must be unique."""
    d = len(columns)
    log_moves = np.log(np.maximum(model.moves, _TINY))

    def product(data):
        return ([best_product(data.reshape(-1, d), model).ravel().tolist()],)

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        k = len(model.start)
        p = np.array(rows["p"].tolist()).reshape(-1, k, k)
        before, best = [], None
        for j in range(len(p)):
            into = np.log(np.maximum(model.start, _TINY)) if best is None else best[:, None] + log_moves
            before.append(into)
            best = ((into if best is None else into.max(axis=0))[:, None] + p[j]).max(axis=0)
        last, lasts, cames = int(best.argmax()), [], []
        for j in range(len(p) - 1, -1, -1):
            lasts.append(last)
            came = None if j == 0 else int((before[j] + p[j][:, last]).max(axis=1).argmax())
            cames.append(-1 if came is None else came)
            last = came
        return pd.DataFrame({"symbol": rows["symbol"], "block": rows["block"], "came": cames[::-1], "last": lasts[::-1]})

    def run(data, times, came, last):
        return list(times), best_path(data.reshape(-1, d), model, None if came < 0 else int(came), int(last))

    packed = settle(blocks(bars, columns, rows=block_rows), "sequences")
    borders = _by_block(packed, product, "p array<double>").groupBy("symbol").applyInPandas(scan, "symbol string, block long, came int, last int")
    kind = bars.schema["ts"].dataType.simpleString()
    found = _by_block(packed.join(borders, ["symbol", "block"]), run, f"ts {kind}, state int", ("times", "came", "last")).drop("block")
    return bars.join(found, ["symbol", "ts"]).select(*bars.columns, "state")


def by_bic(bars: DataFrame, columns: list[str], most: int = 4, **kw) -> DataFrame:
    """Log-likelihood and BIC for each number of states from 2 on."""
    fitted = [(k, fit(bars, columns, k, **kw)) for k in range(2, most + 1)]
    return bars.sparkSession.createDataFrame([(k, s.loglik, s.bic) for k, s in fitted], "states int, loglik double, bic double")
