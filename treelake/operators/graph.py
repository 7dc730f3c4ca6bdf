"""Reachability over an edge table, such as a graph of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.session import cut


def reachable(roots: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, distance) of all nodes that edges (source, target) reach from roots (node).

    One join a round with the nodes found last; rounds end when none is new. Cycles and repeated
    edges make no difference. Lineage is cut each round. More rounds than ``most_rounds`` is an error.
    """
    found = cut(roots.select("node").filter("node is not null").distinct().withColumn("distance", F.lit(0)))
    last = found
    links = edges.select("source", "target").filter("source is not null and target is not null").distinct()
    for step in range(1, most_rounds + 1):
        new = last.join(links, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(step))
        last = cut(new)
        if last.isEmpty():
            return found
        found = found.unionByName(last)
    raise ValueError(f"not all reached in {most_rounds} rounds")
