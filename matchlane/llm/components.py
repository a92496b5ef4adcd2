"""Connected components by label propagation with shortcuts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlane.session import materialise


def connected(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a, b); the label is the smallest node reachable.

    Each round takes the smallest label among the neighbours, then the label of that label, and is
    stored, so the plan stays short. A hub's edges are summed up before they meet.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct()
    links = materialise(both, "links")
    labels = materialise(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "near").alias("low")
        )
        above = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        after = materialise(
            hooked.join(above, "low", "left").select(
                "node", F.least("low", "lower").alias("label"), F.col("label").alias("old")
            ),
            "labels",
        )
        labels = after.select("node", "label")
        if after.where("label != old").isEmpty():
            return labels
