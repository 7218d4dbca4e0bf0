"""Graph operators as fixpoints of joins; each round is written, which cuts the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import discard, written


def closure(edges: DataFrame) -> DataFrame:
    """``edges(parent, child)`` to all pairs ``(ancestor, node)``, by doubling: paths of up to 2^k edges after k rounds.

    Ends on cyclic graphs too, in which a node is its own ancestor.
    """
    paths = written(edges.where("parent is not null and child is not null").select(F.col("parent").alias("ancestor"), F.col("child").alias("node")).distinct(), "paths")
    n = paths.count()
    while True:
        onward = paths.select(F.col("ancestor").alias("node"), F.col("node").alias("far"))
        longer = written(paths.join(onward, "node").select("ancestor", F.col("far").alias("node")).union(paths).distinct(), "paths")
        m = longer.count()
        discard(paths)
        if m == n:
            return longer
        paths, n = longer, m


def layers(edges: DataFrame) -> DataFrame:
    """``edges(parent, child)`` to ``(node, layer)``: a node's layer follows those of all its parents; null for nodes of or behind a cycle."""
    edges = written(edges.distinct(), "edges")
    left = written(edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct(), "nodes")
    placed, layer, rest = None, 0, edges
    while True:
        blocked = rest.select(F.col("child").alias("node")).distinct()
        free = written(left.join(blocked, "node", "left_anti").withColumn("layer", F.lit(layer)), "free")
        if free.isEmpty():
            break
        placed = free if placed is None else placed.unionByName(free)
        fewer = written(left.join(free, "node", "left_anti").select("node"), "nodes")
        fewer_edges = written(rest.join(free.select(F.col("node").alias("parent")), "parent", "left_anti"), "edges")
        discard(left, rest)
        left, rest = fewer, fewer_edges
        layer += 1
    stuck = left.withColumn("layer", F.lit(None).cast("int"))
    return stuck if placed is None else placed.unionByName(stuck)
