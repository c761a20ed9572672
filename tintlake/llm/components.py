"""Connected components of a table of links, by rounds of smallest-label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node that has a link; ``links`` has long columns a, b. The label is the smallest node.

    A round takes the smallest label of a node and its neighbours, then the label of that label; stars, which the
    callers mostly give, end after two or three rounds. Every round is written to the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("new"))
        root = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        step = better.join(root, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("up", "new")).alias("label"))
        step = stored(step, "labels")
        moved = step.filter("old <> label").limit(1).count()
        labels = step.drop("old")
        if not moved:
            return labels
