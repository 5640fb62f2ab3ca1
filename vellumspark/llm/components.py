"""Connected components of a graph in tables: labels fall to the least label of the neighbours until no link joins two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import written


def relabelled(labels: DataFrame, links: DataFrame, files: int | None = None) -> DataFrame:
    """labels (node, label) after the links (a, b) have joined what they touch; every step is a table in the shared folder.

    A label is always the least node of what it has joined so far, so a star takes one step and a chain as many as
    labels have to fall. Sums are map-side minima: a node with a third of all links is no larger a task.
    files: how many a table may have at most (as many as a shuffle has partitions, if None).
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df if files is None else df.coalesce(files), name)

    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = kept(both, "links")
    while True:
        at = labels.select(F.col("node").alias("a"), F.col("label").alias("own"))
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        edges = both.join(at, "a").join(other, "b").where("own <> other").groupBy("own").agg(F.min("other").alias("other"))
        edges = kept(edges.where("other < own"), "label-edges")
        if edges.isEmpty():
            return labels
        fall = edges.select(F.col("own").alias("label"), F.col("other").alias("least"))
        # One pointer jump: what a label falls to may itself fall.
        jump = fall.join(edges.select(F.col("own").alias("least"), F.col("other").alias("least2")), "least", "left")
        jump = jump.select("label", F.coalesce("least2", "least").alias("least"))
        labels = kept(labels.join(jump, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")
