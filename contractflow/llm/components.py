"""Connected components of a graph of verified links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.storage import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label of all nodes with an edge; the label is the smallest node of the component.

    In every round a node takes the smallest label among its neighbours and itself, and then the label
    of that label, so that chains shrink by half; each round is written and read back.
    """
    both = cut_lineage(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
            edges.select(F.col(b).alias("node"), F.col(a).alias("other"))
        ).distinct()
    )
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        near = both.join(theirs, "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        new = cut_lineage(lower.join(jump, "to").select("node", F.least("to", "beyond").alias("label"), "old"))
        if new.where("label < old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
