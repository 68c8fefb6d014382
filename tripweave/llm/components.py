"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the least node reachable.

    Each round a node takes the least label around it and then the label of that label,
    so that distances halve; links inside one component leave as they are found. Every
    round is a written table, so a lost executor costs that round alone.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.keep(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")),
        "labels",
    )
    edges = links.select("a", "b")
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        crossing = scratch.keep(
            edges.join(of_a, "a").join(of_b, "b").filter("la != lb").select("a", "b", "la", "lb"),
            "crossing",
        )
        if crossing.isEmpty():
            # Labels of one component agree now, and each names its own least node.
            return labels
        # The larger label of a crossing link follows the least one it meets.
        moved = (
            crossing.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to"))
            .groupBy("label")
            .agg(F.min("to").alias("to"))
        )
        moved = scratch.keep(moved, "moved")
        onward = moved.select(F.col("label").alias("to"), F.col("to").alias("further"))
        moved = scratch.keep(
            moved.join(onward, "to", "left").select(
                "label", F.coalesce("further", "to").alias("to")
            ),
            "moved",
        )
        labels = scratch.keep(
            labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")),
            "labels",
        )
        edges = crossing.select("a", "b")
