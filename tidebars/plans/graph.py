"""Connected components of an edge list, with tables written to the shared scratch folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars import session


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared scratch folder and read back: its plan ends there, and no later step computes it again."""
    path = session.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of each of nodes (node); edges (a, b) in any order; root is the least node of the component.

    A round gives each node the least root of its neighbours, then the root of its root, so that paths shrink by half.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = settle(nodes.select("node", F.col("node").alias("root")).distinct(), "roots")
    while True:
        met = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("met"))
        lower = settle(now.join(met, now["node"] == met["a"], "left").select("node", "root", F.least("root", F.coalesce("met", "root")).alias("low")), "lower")
        of_root = lower.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        after = settle(lower.join(of_root, "low").select("node", F.col("jump").alias("root"), (F.col("jump") != F.col("root")).alias("moved")), "roots")
        now = after.select("node", "root")
        if after.where("moved").isEmpty():
            return now
