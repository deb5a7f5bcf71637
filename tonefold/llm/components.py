"""Connected components of a graph given as pairs, by passing on the smallest label and following labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, written


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node of the pairs (a, b): the smallest node reachable. Rounds grow with the logarithm of a component's extent."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "theirs").alias("to"))
        lower = written(lower, "lower")
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        last, labels = labels, written(lower.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("further", "to")).alias("component")), "labels")
        dropped(last, lower)
        if labels.where("was <> component").isEmpty():
            dropped(both)
            return labels.select("node", "component")
