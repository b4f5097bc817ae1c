"""Density clusters and neighbour distances against brute force, one dense cell of half the rows included."""

import numpy as np
import pytest

from tidebars.plans import density


def brute(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    name = np.where(core, np.arange(len(x)), len(x))
    while True:
        lower = np.where(core, np.where(near & core[None], name[None], len(x)).min(axis=1), len(x))
        if (lower == name).all():
            break
        name = lower
    edge = np.where(near & core[None], name[None], len(x)).min(axis=1)
    return [(i, bool(core[i]), None if edge[i] == len(x) else int(edge[i])) for i in range(len(x))]


def made(dims, seed):
    r = np.random.default_rng(seed)
    dense = np.full((150, dims), 0.3) + r.normal(0, 0.004, (150, dims))  # half the rows in one cell
    blobs = np.concatenate([r.normal(c, 0.25, (40, dims)) for c in (1.0, 2.0)])
    line = np.linspace(3, 6, 30)[:, None] * np.ones(dims)  # a chain of cells
    return np.concatenate([dense, blobs, line, r.uniform(-3, 7, (30, dims)), dense[:10], [[9.0] * dims] * 3])


@pytest.mark.parametrize("dims, eps, least", [(1, 0.05, 4), (2, 0.3, 6), (2, 0.15, 3), (3, 0.5, 5), (4, 0.6, 4)])
def test_clusters(spark, monkeypatch, dims, eps, least):
    monkeypatch.setattr(density, "CROWD", 40)
    x = made(dims, dims)
    names = [f"f{d}" for d in range(dims)]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(1000, None, *[0.0] * (dims - 1)), (1001, float("nan"), *[0.0] * (dims - 1))]
    table = spark.createDataFrame(rows, ", ".join(["id long", *(f"{n} double" for n in names)])).repartition(3)
    got = sorted(tuple(r) for r in density.cluster(table, "id", names, eps, least).select("id", "core", "cluster").collect())
    want = brute(x, eps, least)
    assert got == want and len({c for *_, c in want}) > 2


@pytest.mark.parametrize("dims, k", [(2, 8), (3, 20), (1, 1)])
def test_neighbour_distances(spark, dims, k):
    x = made(dims, 9)
    names = [f"f{d}" for d in range(dims)]
    table = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ", ".join(["id long", *(f"{n} double" for n in names)])).repartition(3)
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, k - 1]
    got = dict(map(tuple, density.neighbour_distances(table, "id", names, k).collect()))
    np.testing.assert_allclose([got[i] for i in range(len(x))], want, atol=1e-12)


def test_too_few_points(spark):
    table = spark.createDataFrame([(1, 0.0)], "id long, f double")
    assert density.neighbour_distances(table, "id", ["f"], 3).collect()[0]["distance"] is None
    assert density.cluster(table.where("id > 1"), "id", ["f"], 1.0, 2).collect() == []
