"""Connected components of an undirected edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, component long): the smallest node reachable, for every node of ``edges(a, b)``.

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so that chains shrink by doubling; rounds stop when nothing changes. Every
    minimum is pre-aggregated, so a hub with a third of all edges makes no hot task. Edges
    with a null end and loops add nothing. An empty table gives an empty table.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    both = checkpointed(e.union(e.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lower = labels.join(heard, "node").select("node", F.least("component", "low").alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = checkpointed(lower.join(jump, "next", "left").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("was")).alias("moved")))
        moved = step.where("moved").limit(1).count()
        labels = step.select("node", "component")
        if not moved:
            return labels
