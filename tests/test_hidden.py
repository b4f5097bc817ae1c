"""Hidden Markov models by blocks against a walk from end to end, all paths and planted states."""

import datetime
from itertools import product

import numpy as np
import pytest

from tidebars.plans import hidden

MODEL = hidden.States(np.array([0.6, 0.1, 0.3]), np.array([[0.7, 0.3, 0.0], [0.05, 0.9, 0.05], [0.2, 0.0, 0.8]]), np.array([[0.0, 1.0], [2.0, 0.0], [-3.0, 0.5]]), np.array([[1.0, 0.5], [0.5, 1.0], [2.0, 0.1]]))
COLUMNS = ["x", "y"]


def walk(x, s):
    """State probabilities, expected moves, log-likelihood and best path, row by row."""
    log_b = s.log_densities(x)
    peak = log_b.max(axis=1)
    b, n, k = np.exp(log_b - peak[:, None]), len(x), len(s.start)
    alpha, beta, norm = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        a = (s.start if t == 0 else alpha[t - 1] @ s.moves) * b[t]
        norm[t] = a.sum()
        alpha[t] = a / norm[t]
    for t in range(n - 2, -1, -1):
        beta[t] = s.moves @ (b[t + 1] * beta[t + 1]) / norm[t + 1]
    gamma = alpha * beta
    moves = s.moves * (alpha[:-1].T @ (b[1:] * beta[1:] / norm[1:, None]))
    with np.errstate(divide="ignore"):
        best, back = np.log(s.start) + log_b[0], []
        for t in range(1, n):
            every = best[:, None] + np.log(s.moves)
            back.append(every.argmax(axis=0))
            best = every.max(axis=0) + log_b[t]
    path = [int(best.argmax())]
    for p in back[::-1]:
        path.append(int(p[path[-1]]))
    return gamma / gamma.sum(axis=1, keepdims=True), moves, float(np.log(norm).sum() + peak.sum()), path[::-1]


@pytest.fixture(scope="module")
def sequences():
    r = np.random.default_rng(4)
    return {"a": r.normal(0, 2, (1003, 2)), "b": r.normal(0, 5, (260, 2)), "c": r.normal(1, 1, (1, 2))}


@pytest.fixture(scope="module")
def table(spark, sequences):
    at = datetime.datetime(2024, 1, 1)
    rows = [(s, at + datetime.timedelta(hours=k), *map(float, v)) for s, x in sequences.items() for k, v in enumerate(x)] + [("a", at - datetime.timedelta(hours=1), None, 1.0), ("d", at, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, y double").repartition(5)


def test_all_paths():
    x = np.array([[0.1, 1.0], [1.5, 0.2], [2.2, -0.1], [-0.3, 0.9]])
    b = np.exp(MODEL.log_densities(x))
    paths = {p: MODEL.start[p[0]] * b[0, p[0]] * np.prod([MODEL.moves[i, j] * b[t + 1, j] for t, (i, j) in enumerate(zip(p, p[1:]))]) for p in product(range(3), repeat=4)}
    gamma, moves, loglik, path = walk(x, MODEL)
    total = sum(paths.values())
    assert loglik == pytest.approx(np.log(total)) and tuple(path) == max(paths, key=paths.get)
    assert gamma[2, 1] == pytest.approx(sum(v for p, v in paths.items() if p[2] == 1) / total)
    assert moves[0, 1] == pytest.approx(sum(v * sum(m == (0, 1) for m in zip(p, p[1:])) for p, v in paths.items()) / total)


@pytest.mark.parametrize("chunk, rows", [(128, 32768), (7, 50), (16, 100)])
def test_blocks_are_the_walk(table, sequences, monkeypatch, chunk, rows):
    monkeypatch.setattr(hidden, "CHUNK", chunk)
    want = {s: walk(x, MODEL) for s, x in sequences.items()}
    found = hidden.probabilities(table, MODEL, COLUMNS, rows).toPandas().sort_values(["symbol", "ts"])
    paths = hidden.states(table, MODEL, COLUMNS, rows).toPandas().sort_values(["symbol", "ts"])
    for s, x in sequences.items():
        np.testing.assert_allclose(np.array(found[found["symbol"] == s]["chance"].tolist()), want[s][0], atol=1e-9)
        assert paths[paths["symbol"] == s]["state"].tolist() == want[s][3]
    assert hidden.log_likelihood(table, MODEL, COLUMNS, rows) == pytest.approx(sum(w[2] for w in want.values()), rel=1e-12)
    sums = hidden._sums(hidden.blocks(table, COLUMNS, rows=rows), MODEL, 2)
    np.testing.assert_allclose(sums[3:12].reshape(3, 3), sum(w[1] for w in want.values()), rtol=1e-9, atol=1e-12)


def test_planted_states(spark):
    r = np.random.default_rng(3)
    at = datetime.datetime(2024, 1, 1)
    rows = [(s, at + datetime.timedelta(hours=k), float(r.normal(1 + 4 * (k // 60 % 2), 0.5)), float(r.normal(0, 1)), k // 60 % 2) for s in "ab" for k in range(600)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, y double, truth int").cache()
    model = hidden.fit(df, COLUMNS, 2, block_rows=100)
    whole = hidden.fit(df, COLUMNS, 2)
    np.testing.assert_allclose(model.moves, whole.moves, rtol=1e-6)
    found = hidden.states(df, model, COLUMNS, 100).toPandas()
    assert (found["state"] == found["truth"]).mean() > 0.99 and len(found) == 1200
    np.testing.assert_allclose(model.means[:, 0], [1, 5], atol=0.2)
    # 9 moves between stretches of 60 in each sequence of 600
    assert abs(model.moves[0, 1] - 10 / 590) < 0.01
    bic = {r["states"]: r["bic"] for r in hidden.by_bic(df, ["x"], 3, passes=5).collect()}
    assert bic[2] < bic[3] + 60
