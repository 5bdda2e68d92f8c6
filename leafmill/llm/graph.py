"""Connected components of a link table, by labels that shrink along links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); label is the least node of its component.

    Each round a node takes the least label among its neighbours' and its own, then its
    label's label, so that long chains halve. Every round is written to the shared folder.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        moved = materialize(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("onward", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links (a, b); only links between two components are walked."""
    for end in "ab":
        links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    ends = links.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    onward = components(ends.where("a <> b")).select(F.col("node").alias("old"), F.col("label").alias("new"))
    moved = labels.join(onward, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    added = onward.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return materialize(moved.unionByName(added), "labels")
