"""Connected components over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Each round takes the smallest label among neighbours and then jumps to the label's own label, so chains
    shorten by more than half. Every round is a written table. Neighbour minima are combined before the shuffle,
    so a node with very many edges gives one row a task. Loops and repeated edges change nothing; edges with a
    null end are ignored; no edges give no rows.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = materialize(both.union(both.select("y", "x")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels, both.y == labels.node)
            .groupBy("x")
            .agg(F.min("root").alias("near"))
            .select(F.col("x").alias("node"), "near")
        )
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        moved = materialize(
            lower.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")),
            "labels",
        )
        labels = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            return labels
