"""Indicators by blocks of one symbol against the same by whole symbols."""

import datetime

import numpy as np
import pytest

from tidebars.functions import indicators as ind
from tidebars.functions import recurrences
from tidebars.plans import regimes

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(4)
    rows = []
    for symbol, n in (("a", 900), ("b", 40)):
        close = 100 + np.cumsum(r.normal(0, 1, n))
        for k in range(n):
            o = close[k] + r.normal(0, 0.5)
            rows.append((symbol, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k), float(o), float(max(o, close[k]) + r.random()), float(min(o, close[k]) - r.random()), float(close[k]), float(r.integers(0, 50))))
    return spark.createDataFrame(rows, BARS).repartition(3).cache()


def same(a, b):
    x, y = (df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for df in (a, b))
    assert sorted(x.columns) == sorted(y.columns) and len(x) == len(y)
    for c in x.columns:
        if x[c].dtype.kind == "f":
            np.testing.assert_allclose(x[c].to_numpy(), y[c].to_numpy(), rtol=1e-8, atol=1e-8, err_msg=c)
        else:
            assert x[c].equals(y[c].astype(x[c].dtype)), c


def test_windows(bars):
    names = sorted(set(ind.INDICATORS) - ind.UNBOUNDED)
    for at in range(0, len(names), 8):
        same(ind.apply(bars, *names[at : at + 8], block_rows=100), ind.apply(bars, *names[at : at + 8], whole=True))


def test_folds_that_forget(bars, monkeypatch):
    names = sorted(n for n, memory in recurrences.MEMORY.items() if memory <= 1024)
    monkeypatch.setattr(recurrences, "MEMORY", {n: 600 for n in names})
    same(recurrences.apply(bars, *names, block_rows=100), recurrences.apply(bars, *names, whole=True))


def test_folds_of_long_memory(spark):
    """A mean of 100 needs 2000 bars to forget, so this history is longer than the memory as it is."""
    r = np.random.default_rng(1)
    close = 100 + np.cumsum(r.normal(0, 1, 6000))
    high, low = close + r.uniform(0, 2, 6000), close - r.uniform(0, 2, 6000)
    rows = [("a", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k), *map(float, v)) for k, v in enumerate(zip(close, high, low, close, np.ones(6000)))]
    long = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    names = sorted(n for n, memory in recurrences.MEMORY.items() if memory > 1024)
    assert len(rows) > max(recurrences.MEMORY[n] for n in names) + 500
    same(recurrences.apply(long, *names, block_rows=500), recurrences.apply(long, *names, whole=True))


def test_memories_are_long_enough():
    for name, span in (("ema_crosses", 200), ("ema_family", 26), ("adx_wilder", 27)):
        assert (1 - 2 / (span + 1)) ** recurrences.MEMORY[name] < 2**-53


def test_zones(bars, monkeypatch):
    whole = regimes.zone_scores(bars).toPandas().sort_values(["symbol", "ts"])
    from tidebars.functions import frames

    monkeypatch.setattr(frames, "BLOCK_ROWS", 200)
    cut = regimes.zone_scores(bars).toPandas().sort_values(["symbol", "ts"])
    assert whole["zone"].tolist() == cut["zone"].tolist() and set(whole["zone"]) == {-1, 0, 1} and (cut.groupby("symbol")["zone"].head(50) == 0).all()
