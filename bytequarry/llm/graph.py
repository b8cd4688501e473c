"""Connected components of an edge table, by minimum labels and pointer jumping, all in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 60


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round takes the least label among the neighbours and then the label of that label, so a path of n nodes needs
    O(log n) rounds. Labels are written to the shared folder each round. Repeated edges and loops do no harm."""
    both = common.spool(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = common.spool(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), tag)
    for _ in range(ROUNDS):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        after = common.spool(lower.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("beyond", "component")).alias("component")), tag)
        changed = after.filter("was <> component").limit(1).count()
        common.drop_spooled(labels)
        labels = after.select("node", "component")
        if not changed:
            common.drop_spooled(both)
            return labels
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
