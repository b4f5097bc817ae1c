"""Searches and models that SQL can't say, held against exhaustive search, planted structure and held-out rows."""

import datetime

import numpy as np
import pytest

from tidebars.functions import recurrences
from tidebars.operators import relational
from tidebars.plans import learn, search
from tidebars.sources import exchange


def test_genetic_search_finds_what_exhaustive_search_does():
    score = lambda p: -((p[0] - 7) ** 2) - (p[1] - 21) ** 2
    asked = []

    def rate(settings):
        asked.extend(settings)
        return {s: score(s) for s in settings}

    found = search.evolve(rate, [(2, 20), (10, 60)], lambda p: p[0] < p[1], population=24, generations=40, patience=8)
    assert found[-1][0] == (7, 21) and len(asked) == len(set(asked)) < 19 * 51 and all(a[1] <= b[1] for a, b in zip(found, found[1:]))
    assert all(f < s for f, s in asked)


@pytest.fixture(scope="module")
def two_states(spark):
    """Calm and wild stretches in turn, with the true state."""
    r = np.random.default_rng(3)
    rows, at = [], datetime.datetime(2024, 1, 1)
    for symbol in ("a", "b"):
        for k in range(600):
            state = k // 60 % 2
            rows.append((symbol, at + datetime.timedelta(hours=k), float(r.normal(1 + 4 * state, 0.5)), float(r.normal(0, 1)), state))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, y double, truth int").cache()


@pytest.mark.parametrize("kind", ["kmeans", "mixture"])
def test_clusters_are_the_planted_ones(two_states, kind):
    found = learn.clusters(two_states, ["x"], 2, kind).toPandas()
    assert (found["cluster"] == found["truth"]).mean() > 0.99


def test_silhouette_prefers_the_true_number(two_states):
    found = {r["k"]: r["silhouette"] for r in learn.silhouettes(two_states, ["x"], 4).collect()}
    assert max(found, key=found.get) == 2


def test_components_against_a_singular_value_decomposition(two_states):
    scored, shares = learn.principal(two_states, ["x", "y"], 2)
    table = scored.toPandas()
    raw = two_states.toPandas()[["x", "y"]].to_numpy()
    z = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    power = np.linalg.svd(z, compute_uv=False) ** 2
    np.testing.assert_allclose(shares, power / power.sum(), rtol=1e-6)
    np.testing.assert_allclose(np.sort(table[["pc_1", "pc_2"]].var().to_numpy())[::-1] * (len(z) - 1), power, rtol=1e-6)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_trees_on_held_out_rows(two_states, kind):
    table = two_states.withColumn("z", 3 * two_states["x"])
    found = learn.trees(table.where("symbol = 'a'"), table.where("symbol = 'b'"), ["x", "y"], "z", kind).toPandas()
    assert ((found["predicted"] - found["z"]) ** 2).mean() < 0.1 * found["z"].var()


def brute_zigzag(high, low, move):
    """The definition, a pivot at a time: from the last pivot on, the extreme that the price has turned from by `move`."""
    out, way, start = [0.0] * len(high), 0, 0
    while True:
        top = bottom = start
        for i in range(start, len(high)):
            if way >= 0 and i > start and high[i] >= high[top]:
                top = i
            if way <= 0 and i > start and low[i] <= low[bottom]:
                bottom = i
            if way >= 0 and top < i and high[top] - low[i] >= move[i]:
                out[top], way, start = 1.0, -1, i
                break
            if way <= 0 and bottom < i and high[i] - low[bottom] >= move[i]:
                out[bottom], way, start = -1.0, 1, i
                break
        else:
            return out


def test_zigzag():
    import pandas as pd

    r = np.random.default_rng(5)
    for _ in range(20):
        mid = 100 + np.cumsum(r.normal(0, 1, 200))
        b = pd.DataFrame({"high": mid + r.random(200), "low": mid - r.random(200), "close": mid})
        move = recurrences._ewm(recurrences.true_range(b), alpha=0.1, adjust=False).to_numpy() * 2
        found = recurrences.zigzag(b)["zigzag"]
        want = np.array(brute_zigzag(b["high"].to_numpy(), b["low"].to_numpy(), move))
        assert (found == want).all() and want.any()


def test_sample_is_the_same_whatever_the_partitions(spark):
    rows = spark.range(10_000)
    one, two = ({r["id"] for r in relational.sample(x, 0.1, "id").collect()} for x in (rows.repartition(7), rows.coalesce(1)))
    assert one == two and 800 < len(one) < 1200


def test_settings_and_answers_that_do_not_parse(spark):
    assert exchange.Settings.read({"fast": [3, 4]}).fast == (3, 4)
    with pytest.raises(ValueError, match="nope"):
        exchange.Settings.read({"nope": 1})
    lines = spark.createDataFrame([("not json",), ("[]",), (None,), ("[[1704067200000, \"1\", \"2\", \"x\", \"1.5\", \"3\"]]",)], "value string")
    (bar,) = exchange.klines(lines, "s").collect()
    assert (bar["symbol"], bar["ts"], bar["low"], bar["close"]) == ("s", datetime.datetime(2024, 1, 1), None, 1.5)
    assert exchange.agg_trades(lines, "s").count() == exchange.depth(lines, "s").count() == exchange.funding(lines, "s").count() == 0
    with pytest.raises(ValueError, match="none of these"):
        exchange.timeframes(spark, {"1h": "file:///nowhere/x.csv"})
