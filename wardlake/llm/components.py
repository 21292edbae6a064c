"""Connected components of an edge table by repeated minimum labels and pointer jumping.

Every round is a few joins and grouped minima whose results are written to the
shared folder; the driver sees one number a round. Labels halve their distance
to the smallest node of a component in each round, so a star takes two or three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``: (node, component) for every node of an edge, component = the smallest node reachable."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        # one jump: a label takes on the label of the node it names
        jump = lower.join(labels.select(F.col("node").alias("to"), F.col("component").alias("far")), "to")
        new = saved(jump.select("node", "was", F.least("to", "far").alias("component")), "labels")
        if new.where("was <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
