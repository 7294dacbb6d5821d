"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for each node of ``edges(a, b)``; label is the component's smallest node.

    Each round takes the smallest label among a node's neighbours and then follows the
    label's own label (pointer jumping), until a round changes nothing. The edges stay
    as they are, so no node gathers more edges than it has in the graph. Rounds are kept in
    the shared folder; the driver sees only whether one changed anything. An empty edge
    table gives an empty result; loops and repeated edges do no harm.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.first("a"), F.min("b")).alias("label")
    )
    labels = cut_lineage(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        step = cut_lineage(step, "labels")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = step.join(up, "label").select(
            "node", "old", F.least("label", "top").alias("label")
        )
        jumped = cut_lineage(jumped, "labels")
        labels = jumped.drop("old")
        if jumped.filter("label <> old").isEmpty():
            return labels
