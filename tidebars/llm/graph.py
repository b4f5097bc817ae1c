"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import drop_table, materialize


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, name: str, rows: int) -> DataFrame:
    """edges with m, the least v of each u. The minima are written first, so that both sides of the join
    are shuffled anew and adaptive execution can split the edges of a hot u."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), name, rows)
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each node of edges (a, b) but the least of each component; component is the least id.

    Each round links every node's larger neighbours to its least one, then its smaller ones; the number
    of rounds grows with the logarithm of the longest path. Edges are written to the scratch folder
    after each round.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(ordered, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "large", 2 * mark[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "large", mark[0])
        stars = _with_least(large, "small", mark[0])
        small = stars.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges", mark[0])
        new = _mark(after)
        drop_table(large)
        drop_table(now)
        now = after
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
