"""Connected components of a graph of long ids, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import discard, stored


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least label of each component.

    ``edges`` has a, b (long); ``nodes`` has node and label, any orderable
    type with a field ``node`` naming the node it is from. Each round takes
    the least label of the neighbours, then the label of the label's own
    node, which halves the way that is left. Only nodes with an edge return.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "edges")
    ends = both.select(F.col("a").alias("node")).distinct()
    labels = stored(ends.join(nodes, "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
        least = near.agg(F.min("label").alias("near"))
        moved = labels.join(least, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = moved.select(F.col("node").alias("via"), F.col("new").alias("far"))
        stepped = moved.join(jump, F.col("new.node") == F.col("via")).select(
            "node", F.least("new", "far").alias("label"), "old"
        )
        after = stored(stepped, "labels")
        discard(labels)
        labels = after
        if after.where(F.col("label") != F.col("old")).isEmpty():
            discard(both)
            return after.select("node", "label")
