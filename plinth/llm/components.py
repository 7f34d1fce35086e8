"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import materialize, scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of its component, for each node of an edge.

    Labels sink along edges and then jump to the label of their label, so the rounds
    grow with the logarithm of a component's width. Every round is written to the
    shared folder; all but the last are deleted at the end. A hub is one row among the labels, and sums over its edges are
    partial ones, so no task gets a component as a whole.
    """
    with scratch() as kept:
        both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
        both = materialize(both.filter("node <> other").distinct(), "cc-edges")
        labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "cc-labels")
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        while total is not None:
            near = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
            low = both.join(near, "other").groupBy("node").agg(F.min("near").alias("near"))
            sunk = labels.join(low, "node").select("node", F.least("label", "near").alias("label"))
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = materialize(sunk.join(jump, "label", "left").select("node", F.least("label", "next").alias("label")), "cc-labels")
            now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
            if now == total:
                break
            total = now
        kept.append(labels)
    return labels
