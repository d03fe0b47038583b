"""Connected components of a graph given by edges, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of edges(a, b) reaches.

    Each round takes the smallest label next to a node and then the label of that label, so
    a chain of n nodes takes about log n rounds. Labels are written once a round.
    """
    both = settle(edges.select("a", "b").where("a <> b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = settle(least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"))
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels
