"""Connected components of a graph given as a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """edges(a, b) -> (node, label): the smallest node that can be reached, for every node that has an edge.

    Each round lets a node follow its smallest neighbour, jumps two steps ahead, and draws the edges between what
    is left.  Only distinct edges between different labels go on, so a node with very many edges shrinks at
    once; sums and minima are combined before the shuffle.
    """
    edges = work.put(edges.filter(F.col("a") != F.col("b")).distinct(), f"{name}-edges0")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("b", "a"))
        up = work.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-up{turn}")
        for jump in range(2):
            higher = up.select(F.col("a").alias("m"), F.col("m").alias("m2"))
            up = work.put(up.join(higher, "m", "left").select("a", F.coalesce("m2", "m").alias("m")), f"{name}-up{turn}-{jump}")
        labels = labels.join(up.select(F.col("a").alias("label"), "m"), "label", "left").select(
            "node", F.coalesce("m", "label").alias("label"))
        labels = work.put(labels, f"{name}-labels{turn}")
        left, right = up.select("a", F.col("m").alias("ma")), up.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        edges = edges.join(left, "a").select("ma", "b").distinct().join(right, "b").filter("ma <> mb").select(
            F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        edges = work.put(edges, f"{name}-edges{turn}")
        work.drop(f"{name}-up{turn}", f"{name}-up{turn}-0", f"{name}-up{turn}-1", f"{name}-edges{turn - 1}",
                  *([f"{name}-labels{turn - 1}"] if turn > 1 else []))
    return labels
