"""Connected components of an undirected graph that is only ever held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.tables import checkpoint


def components(links: DataFrame) -> DataFrame:
    """`node` and `label`, the smallest node it can reach, for all nodes of `links` (columns a, b).

    Each round takes the smallest label among the neighbours and then follows labels of labels,
    so the distance covered about doubles. Rounds end when no label changes.
    """
    edges = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    edges = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    nodes = edges.groupBy("node").agg(F.min("other").alias("least"))
    labels = checkpoint(nodes.select("node", F.least("node", "least").alias("label")))
    # With an edge to itself, a node's own label is among its neighbours'.
    edges = checkpoint(edges.unionByName(labels.select("node", F.col("node").alias("other"))))
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("their"))
        near = edges.join(theirs, "other").groupBy("node").agg(
            F.min("their").alias("label"), F.max(F.when(F.col("node") == F.col("other"), F.col("their"))).alias("before")
        )
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = checkpoint(near.join(roots, "label").select("node", F.col("root").alias("label"), "before"))
        labels = jumped.select("node", "label")
        if not jumped.filter("label <> before").limit(1).count():
            return labels
