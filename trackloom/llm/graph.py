"""Connected components by smallest label, over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.materialize import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every end of an edge (a, b): comp is the smallest vertex that v reaches.

    Each step takes the smallest label among the neighbours and then the label of that label, so paths shorten by
    doubling. Messages to a vertex are aggregated before they are shuffled. Steps are cut by reliable checkpoints.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels, both["a"] == labels["v"]).groupBy(F.col("b").alias("v")).agg(F.min("comp").alias("_near"))
        step = labels.join(near, "v").select("v", F.col("comp").alias("_was"), F.least("comp", "_near").alias("_l"))
        jump = labels.select(F.col("v").alias("_l"), F.col("comp").alias("_up"))
        step = cut_lineage(step.join(jump, "_l", "left").select("v", "_was", F.least("_l", F.coalesce("_up", "_l")).alias("comp")))
        labels = step.select("v", "comp")
        if step.filter("comp <> _was").isEmpty():
            return labels
