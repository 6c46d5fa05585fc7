"""Connected components of an edge table, distributed.

Every round lowers each node's label to the least label among its neighbours and itself,
then to its label's own label (pointer jumping), and writes the table to the shared folder.
It ends when a round changes nothing, so the result is exact for any shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def label(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the least node it reaches."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.keep(both, "edges")
    labels = kept = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        lower = scratch.keep(lower, "lower")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root"))
        moved = scratch.keep(moved, "labels")
        for done in (kept, lower):
            scratch.release(done)
        kept, labels = moved, moved.select("node", "root")
        if moved.where("root <> was").limit(1).count() == 0:
            return labels
