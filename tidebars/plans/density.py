"""Density clustering over a grid, without comparing the points of a dense place with each other.

Cells have side eps / sqrt(d), so that all points of a cell are neighbours. A cell with min_samples
points or more holds core points only, which no comparison has to show. The points of other cells, fewer
than min_samples in each, are compared with those of the cells around: as a cell has a bounded number of
cells around it, each point meets a bounded number of such points, and the work grows with the points.
Cells with core points are linked if two of their core points are neighbours. To see that, the core
points of a cell are boxed by quarter sides: two boxes link their cells if all of their points must be
neighbours, and only boxes that may or may not hold neighbours are opened. Components of linked cells
are the clusters. A crowded cell is cut by salt, so that it takes many tasks.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.operators.stats import quantiles
from tidebars.plans.graph import components, settle

#: Points of one cell that meet others in one task.
CROWD = 50_000
#: Columns by which cells are looked up; further ones are only compared.
INDEXED = 3


def _cells(x: str, side: float) -> Column:
    return F.transform(x, lambda v: F.floor(v / side))


def _around(cell: str, reach: int, dims: int) -> Column:
    """The lookup keys of the cells around a cell: its first coordinates, each moved by up to reach."""
    keys = F.array(F.array().cast("array<bigint>"))
    for d in range(min(dims, INDEXED)):
        keys = _grown(keys, F.sequence(F.get(cell, F.lit(d)) - reach, F.get(cell, F.lit(d)) + reach))
    return keys


def _grown(keys: Column, step: Column) -> Column:
    return F.flatten(F.transform(keys, lambda k: F.transform(step, lambda c: F.array_append(k, c))))


def _apart(a: str, b: str) -> Column:
    """The squared distance of two points."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda n, x: n + x)


def _points(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    full = [F.col(c).cast("double") for c in columns]
    fine = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in full]
    kept = table
    for ok in fine:
        kept = kept.where(ok)
    return kept.select(F.col(key).alias("id"), F.array(*full).alias("x"))


def _salted(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points with n, the points of their cell, and salt: parts of at most about CROWD points of a cell."""
    return points.join(cells, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CROWD)))


def cluster(table: DataFrame, key: str, columns: list[str], eps: float, min_samples: int) -> DataFrame:
    """key, core, cluster: a core point has min_samples points (itself included) at most eps away; a cluster's name is
    its least core key; points that are near a core point take the least name around them; others, noise, have none.

    key must be unique. Rows with a null, infinite or missing value in columns take no part.
    """
    if eps <= 0:
        raise ValueError("eps must be over 0")
    dims, side = len(columns), eps / sqrt(len(columns))
    reach = int(sqrt(dims)) + 1
    lookup = lambda c: F.slice(c, 1, min(dims, INDEXED))
    points = settle(_points(table, key, columns).withColumn("cell", _cells("x", side)), "points")
    cells = settle(points.groupBy("cell").agg(F.count("*").alias("n")), "cells")
    # cells whose borders are at most eps apart, in units of side: gaps of |step| - 1
    near = F.aggregate(F.zip_with("a", "b", lambda p, q: F.greatest(F.abs(p - q) - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda n, g: n + g * g) <= dims
    left = cells.select(F.col("cell").alias("a"), F.col("n").alias("na"), F.explode(_around("cell", reach, dims)).alias("at"))
    right = cells.select(F.col("cell").alias("b"), F.col("n").alias("nb"), lookup("cell").alias("at"))
    pairs = settle(left.join(right, "at").where(near & (F.col("a") != F.col("b"))).drop("at"), "cell-pairs")

    sparse = points.join(cells.where(F.col("n") < min_samples), "cell")
    dealt = settle(_salted(points, cells), "dealt")
    own = sparse.select("id", "x", F.col("cell").alias("a")).join(pairs.where(F.col("na") < min_samples).select("a", F.col("b").alias("cell"), F.col("nb").alias("n")), "a")
    own = own.unionByName(sparse.select("id", "x", F.col("cell").alias("a"), "cell", "n"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / CROWD) - 1))).drop("n", "a")
    met = own.select("cell", "salt", F.col("id").alias("p"), F.col("x").alias("px")).join(dealt.select("cell", "salt", "id", "x"), ["cell", "salt"]).where(_apart("px", "x") <= eps * eps)
    counts = met.groupBy("p").agg(F.count("*").alias("near"))
    judged = sparse.join(counts, sparse["id"] == counts["p"]).select("id", (F.col("near") >= min_samples).alias("core"))
    cores = settle(judged.where("core").select("id"), "sparse-cores")

    dense = dealt.where(F.col("n") >= min_samples)
    core = settle(dense.select("id", "x", "cell").unionByName(dealt.join(cores, "id").select("id", "x", "cell")), "cores")
    roots = _linked(core, pairs, side, eps, dims)
    named = core.join(roots, "cell").select("id", "cell", "root")
    names = named.groupBy("root").agg(F.min("id").alias("cluster"))
    of_cell = settle(roots.join(names, "root").select("cell", "cluster"), "cell-clusters")

    rest = sparse.join(cores, "id", "left_anti").select(F.col("id").alias("p"))
    # a neighbour that is a core point names its neighbours that are none
    touched = met.join(rest, "p").join(core.select("id", F.lit(True).alias("is_core")), "id").join(of_cell, "cell").groupBy("p").agg(F.min("cluster").alias("cluster"))
    out = core.select("id", "cell").join(of_cell, "cell").select("id", F.lit(True).alias("core"), "cluster")
    edge = rest.join(touched, "p", "left").select(F.col("p").alias("id"), F.lit(False).alias("core"), "cluster")
    return out.unionByName(edge).withColumnRenamed("id", key)


def _linked(core: DataFrame, pairs: DataFrame, side: float, eps: float, dims: int) -> DataFrame:
    """(cell, root) of the cells with core points."""
    with_core = core.select("cell").distinct()
    between = pairs.where(F.col("a") < F.col("b")).select("a", "b")
    between = between.join(with_core.withColumnRenamed("cell", "a"), "a").join(with_core.withColumnRenamed("cell", "b"), "b")
    small = core.withColumn("box", _cells("x", side / 4))
    boxes = settle(small.groupBy("cell", "box").agg(*[F.min(F.get("x", F.lit(d))).alias(f"lo{d}") for d in range(dims)], *[F.max(F.get("x", F.lit(d))).alias(f"hi{d}") for d in range(dims)]), "boxes")
    p, q = (boxes.select(F.col("cell").alias(c), F.col("box").alias(f"{c}_box"), *[F.col(f"{e}{d}").alias(f"{c}_{e}{d}") for e in ("lo", "hi") for d in range(dims)]) for c in ("a", "b"))
    gap = lambda d: F.greatest(F.col(f"a_lo{d}") - F.col(f"b_hi{d}"), F.col(f"b_lo{d}") - F.col(f"a_hi{d}"), F.lit(0.0))
    span = lambda d: F.greatest(F.col(f"a_hi{d}") - F.col(f"b_lo{d}"), F.col(f"b_hi{d}") - F.col(f"a_lo{d}"))
    least, most = sum((gap(d) * gap(d) for d in range(dims)), F.lit(0.0)), sum((span(d) * span(d) for d in range(dims)), F.lit(0.0))
    # a little slack, so that no rounding of a box's distance decides
    held = settle(between.join(p, "a").join(q, "b").where(least <= eps * eps * (1 + 1e-9)).select("a", "b", "a_box", "b_box", (most <= eps * eps * (1 - 1e-9)).alias("sure")), "box-pairs")
    sure = held.where("sure").select("a", "b").distinct()
    open_ = held.join(sure, ["a", "b"], "left_anti")
    ax, bx = (small.select(F.col("cell").alias(c), F.col("box").alias(f"{c}_box"), F.col("x").alias(f"{c}_x")) for c in ("a", "b"))
    found = open_.join(ax, ["a", "a_box"]).join(bx, ["b", "b_box"]).where(_apart("a_x", "b_x") <= eps * eps).select("a", "b").distinct()
    return components(with_core.withColumnRenamed("cell", "node"), sure.union(found)).select(F.col("node").alias("cell"), "root")


def neighbour_distances(table: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """key and distance to the k-th nearest point, itself the first; null where there are fewer than k points.

    Equal points are one point with a weight. Cells begin so small that none holds many points; points with k points
    within a cell's side are done, the side doubles for the others, which are few around any cell.
    """
    dims = len(columns)
    points = settle(_points(table, key, columns), "points")
    distinct = settle(points.groupBy("x").agg(F.count("*").alias("w")), "distinct")
    edges = distinct.agg(F.count("*").alias("n"), F.sum("w").alias("all"), *[(F.max(F.get("x", F.lit(d))) - F.min(F.get("x", F.lit(d)))).alias(f"r{d}") for d in range(dims)]).first()
    none = points.select(F.col("id").alias(key), F.lit(None).cast("double").alias("distance"))
    if not edges["n"] or edges["all"] < k:
        return none
    widest = max(edges[f"r{d}"] for d in range(dims)) or 1.0
    side = widest / max(1.0, edges["n"] ** (1 / dims))
    while distinct.groupBy(_cells("x", side).alias("c")).count().agg(F.max("count")).first()[0] > 16 * k and side > widest * 1e-12:
        side /= 2
    done, left = None, distinct.select("x")
    while True:
        lookup = F.slice(_cells("x", side), 1, min(dims, INDEXED))
        mine = left.select(F.col("x").alias("p"), F.explode(_around_of("x", side, dims)).alias("at"))
        near = mine.join(distinct.select("x", "w", lookup.alias("at")), "at").select("p", "w", F.sqrt(_apart("p", "x")).alias("d")).where(F.col("d") <= side)
        so_far = F.sum("w").over(Window.partitionBy("p").orderBy("d").rangeBetween(Window.unboundedPreceding, 0))
        reached = settle(near.withColumn("s", so_far).where(F.col("s") >= k).groupBy("p").agg(F.min("d").alias("distance")), "reached")
        done = reached if done is None else done.unionByName(reached)
        left = settle(left.join(reached.select(F.col("p").alias("x")), "x", "left_anti"), "left")
        if left.isEmpty():
            return points.join(done.withColumnRenamed("p", "x"), "x").select(F.col("id").alias(key), "distance")
        side *= 2


def _around_of(x: str, side: float, dims: int) -> Column:
    keys = F.array(F.array().cast("array<bigint>"))
    for d in range(min(dims, INDEXED)):
        at = F.floor(F.get(x, F.lit(d)) / side)
        keys = _grown(keys, F.sequence(at - 1, at + 1))
    return keys


def suggested(table: DataFrame, key: str, columns: list[str]) -> tuple[float, int]:
    """eps and min_samples from the data: the 75th percentile of the distances to the k-th nearest point, where k is 20 or a tenth of the rows; one row in a hundred, 5 at least."""
    n = _points(table, key, columns).count()
    found = neighbour_distances(table, key, columns, max(1, min(20, n // 10)))
    eps = quantiles(found.withColumn("__whole", F.lit(0)), ["__whole"], "distance", {"eps": 0.75}).first()
    return float(eps and eps["eps"] or 0.0), max(5, n // 100)
