"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """`node long` and `root long`, the smallest node reachable, for every node of an edge (a, b).

    Each round lets every node point to its smallest neighbour, follows the pointers to their ends
    (doubling the distance at each step), and merges what then points to the same node; the edges
    left between merged nodes go into the next round.  Every round at least halves the nodes of a
    component.  All steps are aggregations and joins over written tables.
    """
    left = materialize(_both(edges.select("a", "b").where("a <> b")), "edges")
    nodes = materialize(left.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    while not left.isEmpty():
        pointer = _followed(left.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        nodes = materialize(_renamed(nodes, "root", pointer), "nodes")
        left = materialize(_renamed(_renamed(left, "a", pointer), "b", pointer).where("a <> b").distinct(), "edges")
    return nodes


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _followed(pointer: DataFrame) -> DataFrame:
    """Pointers (a, to) followed to their ends; they never rise, so there are no circles."""
    pointer = materialize(pointer, "pointers")
    while True:
        further = pointer.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
        jumped = pointer.join(further, F.col("to") == F.col("_a"), "left").select(
            "a", F.coalesce("_to", "to").alias("to"), (F.col("_to") < F.col("to")).alias("moved")
        )
        jumped = materialize(jumped, "pointers")
        moved = not jumped.where("moved").isEmpty()
        pointer = jumped.select("a", "to")
        if not moved:
            return pointer


def _renamed(table: DataFrame, column: str, pointer: DataFrame) -> DataFrame:
    """`table` with the nodes of a column replaced by what they point to."""
    to = pointer.select(F.col("a").alias("_from"), F.col("to").alias("_to"))
    joined = table.join(to, F.col(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).select(*table.columns)
