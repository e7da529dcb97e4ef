"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of (a, b) edges the smallest node that it is connected to.

    Each round takes the smallest label among the neighbours and then that label's own label, so long
    chains shorten by half. Rounds are written to the shared folder; it ends when no label changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
                     .select(F.col("a").alias("node"), "label"), "labels")
    while True:
        told = (both.join(labels, F.col("b") == F.col("node")).groupBy("a")
                .agg(F.min("label").alias("heard")))
        near = (labels.join(told, F.col("node") == F.col("a"))
                .select("node", "label", F.least("label", "heard").alias("near")))
        step = near.alias("x").join(
            labels.select(F.col("node").alias("n2"), F.col("label").alias("l2")),
            F.col("near") == F.col("n2"), "left")
        new = written(step.select("node", F.least("near", "l2").alias("label"),
                                  (F.least("near", "l2") < F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels
