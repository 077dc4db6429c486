"""Connected components by propagating the smallest label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs, either direction, loops and repeats allowed). Returns node and component, the smallest node
    that can be reached, for every node of an edge.

    Each round a node takes the smallest label among its neighbours' and its own, and then the label of that label, so
    the number of rounds grows with the logarithm of the longest path in practice. Labels are counted by partial
    aggregation and joined by sort-merge joins, whose hot keys adaptive execution splits. Each round is written to the
    shared folder and the one before it removed.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    old = labels
    while True:
        near = both.join(labels.hint("merge"), both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        best = labels.join(near.hint("merge"), labels.node == near.u).select("node", "label", F.least("label", "m").alias("next"))
        jump = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = best.join(jump.hint("merge"), best.next == jump.n2, "left")
        new = materialise(new.select("node", "label", F.least("next", F.coalesce("l2", "next")).alias("new")), "labels")
        discard(old)
        old, labels = new, new.select("node", F.col("new").alias("label"))
        if new.where("new <> label").isEmpty():
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
