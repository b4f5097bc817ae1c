"""Least squares, decompositions, ARIMA, spectra and crossings against numpy and against plain loops."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import crossing
from tidebars.plans import arima, linear, spectrum

AT = datetime.datetime(2024, 1, 1)


def series(spark, values, minutes=60, name="x"):
    rows = [(s, AT + datetime.timedelta(minutes=minutes * k), None if v is None else float(v)) for s, x in values.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, f"symbol string, ts timestamp_ntz, {name} double").repartition(3)


def test_least_squares(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, [1, 100, 1e-3, 0], (300, 4)) + [0, 1e4, 5, 7]
    y = x @ [2, -0.5, 300, 1] + r.normal(0, 1, 300)
    rows = [("ab"[k % 3 // 2], *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y))] + [("a", None, 1.0, 1.0, 1.0, 1.0), ("c", 1.0, 1.0, 1.0, 7.0, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double, c double, d double, y double").repartition(3)
    found = {r["symbol"]: r for r in linear.least_squares(df, {c: F.col(c) for c in "abcd"}, F.col("y")).collect()}
    for s in "ab":
        own = np.array([k % 3 // 2 == "ab".index(s) for k in range(300)])
        design = np.c_[np.ones(own.sum()), x[own, :3]]
        want = np.linalg.lstsq(design, y[own], rcond=None)[0]
        got = np.array(found[s]["coefficients"])
        np.testing.assert_allclose(got[:3], want[1:], rtol=1e-6)
        assert found[s]["n"] == own.sum() and got[3] == 0
        np.testing.assert_allclose(design[:, 1:] @ got[:3] + found[s]["intercept"], design @ want, rtol=1e-8)
        left = y[own] - design @ want
        assert found[s]["r2"] == pytest.approx(1 - left @ left / ((y[own] - y[own].mean()) ** 2).sum(), abs=1e-9)
    assert found["c"]["intercept"] == 5 and found["c"]["coefficients"] == [0.0] * 4


def test_ridge(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (200, 2))
    y = x @ [1.0, 3.0] + r.normal(0, 0.1, 200)
    df = spark.createDataFrame([("a", *map(float, v), float(t)) for v, t in zip(x, y)], "symbol string, a double, b double, y double")
    got = np.array(linear.least_squares(df, {"a": F.col("a"), "b": F.col("b")}, F.col("y"), {"b": 0.5}).first()["coefficients"])
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    want = np.linalg.solve(z.T @ z / 200 + np.diag([0, 0.5]), z.T @ t / 200) * y.std() / x.std(0)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_polynomials(spark):
    r = np.random.default_rng(3)
    values = {"a": np.cumsum(r.normal(0, 1, 500)), "b": r.normal(0, 1, 9)}
    df = series(spark, values)
    for degree in (1, 5):
        got = linear.polynomial_beyond(df, "x", degree, 7).toPandas().sort_values(["symbol", "row"])
        for s, x in values.items():
            want = np.polynomial.Polynomial.fit(np.arange(len(x)), x, degree)(np.arange(len(x) + 7))
            own = got[got["symbol"] == s]
            np.testing.assert_allclose(own["fitted"], want, rtol=1e-6, atol=1e-6)
            assert own["beyond"].sum() == 7


def test_decomposition_finds_what_was_planted(spark):
    r = np.random.default_rng(4)
    t = np.arange(24 * 7 * 8)
    level = np.where(t < 700, 0.02 * t, 14 - 0.01 * (t - 700))
    daily, weekly = 3 * np.sin(2 * np.pi * t / 24), 2 * np.cos(2 * np.pi * t / 168)
    x = 50 + level + daily + weekly + r.normal(0, 0.2, len(t))
    x = [None if k % 97 == 5 else v for k, v in enumerate(x)]
    got = linear.decompose(series(spark, {"a": x[:-48]}), "x", 48, 3600).toPandas().sort_values("ts")
    assert len(got) == len(t) and got["beyond"].sum() == 48
    assert np.abs(got["daily"] - daily).max() < 0.2 and np.abs(got["trend"] - got["trend"].mean() - level + level.mean()).max() < 1
    assert np.abs(got["fitted"] - (50 + level + daily + weekly))[-48:].max() < 0.8


def test_levinson_is_the_solution():
    r = np.random.default_rng(5)
    x = r.normal(0, 1, 400)
    gamma = np.array([x[k:] @ x[: len(x) - k] for k in range(7)]) / 400
    matrix = gamma[np.abs(np.subtract.outer(range(6), range(6)))]
    phi, variance = arima.levinson(gamma)
    np.testing.assert_allclose(phi, np.linalg.solve(matrix, gamma[1:]), rtol=1e-10)
    assert variance == pytest.approx(gamma[0] - phi @ gamma[1:])
    assert arima.levinson(np.zeros(4))[0].tolist() == [0, 0, 0]


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(6)
    e = r.normal(0, 1, 6000)
    ar, arma = np.zeros(6000), np.zeros(6000)
    for t in range(3, 6000):
        ar[t] = 0.6 * ar[t - 1] - 0.3 * ar[t - 2] + 0.2 * ar[t - 3] + e[t]
        arma[t] = 0.7 * arma[t - 1] + e[t] + 0.5 * e[t - 1]
    return {"ar": ar + 10, "arma": arma - 4}


def test_planted_coefficients(spark, planted):
    df = series(spark, planted, 10).cache()
    ar = {r["symbol"]: r for r in arima.fit(df, "x", 3).collect()}["ar"]
    x = planted["ar"] - planted["ar"].mean()
    gamma = np.array([x[k:] @ x[: len(x) - k] for k in range(4)]) / len(x)
    np.testing.assert_allclose(ar["phi"], np.linalg.solve(gamma[np.abs(np.subtract.outer(range(3), range(3)))], gamma[1:]), rtol=1e-9)
    np.testing.assert_allclose(ar["phi"], [0.6, -0.3, 0.2], atol=0.04)
    arma = {r["symbol"]: r for r in arima.fit(df, "x", 1, 1).collect()}["arma"]
    assert abs(arma["phi"][0] - 0.7) < 0.05 and abs(arma["theta"][0] - 0.5) < 0.05 and abs(arma["variance"] - 1) < 0.08


def test_forecasts(spark):
    """A sum of a line, a season and a random walk: differences are undone step by step."""
    r = np.random.default_rng(7)
    x = 3 + 0.5 * np.arange(300) + np.tile([5, -2, 0, 1], 75) + np.cumsum(r.normal(0, 0.3, 300))
    df = series(spark, {"a": x, "short": x[:4]})
    got = arima.forecast(df, "x", (2, 1, 0), 6, season=4).toPandas().sort_values("step")
    assert set(got["symbol"]) == {"a"}
    w = np.diff(x[4:] - x[:-4])
    mean, away = w.mean(), w - w.mean()
    gamma = np.array([away[k:] @ away[: len(away) - k] for k in range(3)]) / len(w)
    phi = np.linalg.solve([[gamma[0], gamma[1]], [gamma[1], gamma[0]]], gamma[1:])
    xs, ws = list(x), list(away)
    for _ in range(6):
        ws.append(phi @ ws[: -3 : -1])
        xs.append(ws[-1] + mean + xs[-1] + xs[-4] - xs[-5])
    np.testing.assert_allclose(got["forecast"], xs[-6:], rtol=1e-9)


@pytest.mark.parametrize("rows", [65536, 16])
def test_spectrum(spark, monkeypatch, rows):
    monkeypatch.setattr(spectrum, "TASK_ROWS", rows)
    r = np.random.default_rng(8)
    values = {f"s{n}": r.normal(3, 10, n) for n in (1, 2, 3, 97, 256)}
    found = spectrum.fourier(series(spark, values), "x").toPandas().sort_values(["symbol", "at"])
    for s, x in values.items():
        own = found[found["symbol"] == s]
        np.testing.assert_allclose(own["re"] + 1j * own["im"], np.fft.fft(x), rtol=1e-9, atol=1e-9)


def test_harmonics_beyond_the_data(spark):
    t = np.arange(200)
    x = 5 + 0.3 * t + 4 * np.cos(2 * np.pi * t / 20 + 1) + 2 * np.sin(2 * np.pi * t / 8)
    got = spectrum.harmonics_beyond(series(spark, {"a": x}), "x", 4, 25).toPandas().sort_values("row")
    slope = np.polyfit(t, x, 1)[0]
    four = np.fft.fft(x - slope * t)
    order = sorted(range(200), key=lambda k: (-round(abs(four[k]) / 200, 9), -k))[:9]
    at = np.arange(225)
    want = sum(abs(four[k]) / 200 * np.cos(2 * np.pi * k * at / 200 + np.angle(four[k])) for k in order) + slope * at
    np.testing.assert_allclose(got["fitted"], want, atol=1e-8)
    assert got["beyond"].sum() == 25


def plain_next(values, levels, up):
    out = []
    for i, level in enumerate(levels):
        later = [j for j in range(i + 1, len(values)) if level is not None and not np.isnan(values[j]) and (values[j] >= level if up else values[j] <= level)]
        out.append(later[0] if later else None)
    return out


@pytest.mark.parametrize("block, crowd, up", [(32768, 100_000, True), (16, 7, True), (50, 3, False)])
def test_next_reaching(spark, monkeypatch, block, crowd, up):
    monkeypatch.setattr(crossing, "CROWD", crowd)
    r = np.random.default_rng(9)
    walk = np.round(np.cumsum(r.normal(0, 1, 400)))
    values = {"a": walk, "b": np.arange(60.0)[::-1], "c": np.r_[np.zeros(100), 100, np.nan, 7], "d": [1.0]}
    rows = [(s, AT + datetime.timedelta(hours=k), float(v), None if k % 5 == 0 or np.isnan(v) else float(v + (2 if up else -2) * (k % 7))) for s, x in values.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, v double, l double").repartition(3)
    got = crossing.next_reaching(df, "l", "v", up, block_rows=block)
    assert got.columns == ["symbol", "ts", "v", "l", "reached"]
    found = {(r["symbol"], r["ts"]): r["reached"] for r in got.collect()}
    assert len(found) == len(rows)
    for s, x in values.items():
        own = [r for r in rows if r[0] == s]
        for k, j in enumerate(plain_next(list(x), [r[3] for r in own], up)):
            assert found[s, own[k][1]] == (None if j is None else own[j][1]), (s, k)


def test_first_reaching():
    r = np.random.default_rng(10)
    for n in (1, 2, 7, 64):
        values = r.integers(0, 9, n).astype(float)
        start, levels = r.integers(0, n + 1, 50), r.integers(0, 11, 50).astype(float)
        want = [next((j for j in range(s, n) if values[j] >= v), n) for s, v in zip(start, levels)]
        assert crossing.first_reaching(values, start, levels).tolist() == want
