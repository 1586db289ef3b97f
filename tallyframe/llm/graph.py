"""Connected components of an edge table, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); label is the least node of its component.

    A round maps each node to the least of itself and its neighbours, and each edge to the images of its ends;
    edges that fall together or into one node go, so a dense group is gone after one round. The rounds' maps are
    chained. Every table is written to the shared folder; nothing but a count comes to the driver.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    chain = None
    while True:
        # a is less than b: b's least neighbour is an a, and a node that is never a b maps to itself.
        low = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
        own = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label"))
        step = materialize(low.unionByName(own).groupBy("node").agg(F.min("label").alias("label")), "step")
        if chain is None:
            chain = step
        else:
            up = step.select(F.col("node").alias("at"), F.col("label").alias("upper"))
            chain = materialize(chain.join(up, F.col("label") == F.col("at"), "left").select("node", F.coalesce("upper", "label").alias("label")), "labels")
        names = [step.select(F.col("node").alias(f"n{e}"), F.col("label").alias(f"l{e}")) for e in "ab"]
        moved = edges.join(names[0], F.col("a") == F.col("na")).join(names[1], F.col("b") == F.col("nb")).where("la <> lb")
        edges = materialize(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return chain
