"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.plans.materialise import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that an edge (a, b) names; component is the smallest id of its component.

    Each round takes the smallest label among neighbours and then the label of the label, so
    the rounds grow with the logarithm of the longest path. Every round is written to the
    shared folder; only the number of changed labels comes back to the driver. Self-loops,
    repeated edges and an empty table are fine; a null end drops the edge.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    e = materialise(e.union(e.select(F.col("b"), F.col("a"))))
    labels = materialise(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    if labels.isEmpty():
        return labels
    for _ in range(max_rounds):
        seen = e.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = materialise(hooked.join(root, "component").select("id", "was", F.least("component", "up").alias("component")))
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
