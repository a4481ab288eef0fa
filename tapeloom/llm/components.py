"""Connected components of an edge table by rounds of smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component.

    edges has columns a, b. Every round gives each node the smallest label around it and then
    the label of its label, so chains shorten geometrically. A round is aggregates and joins
    only; its table is written to the shared folder, so a lost executor costs one round.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("_l").alias("_l"))
        )
        lower = labels.join(around, "node").select("node", F.least("label", "_l").alias("_low"), F.col("label").alias("_old"))
        up = labels.select(F.col("node").alias("_low"), F.col("label").alias("_up"))
        found = materialize(lower.join(up, "_low").select("node", "_old", F.least("_low", "_up").alias("label")))
        labels = found.select("node", "label")
        if found.filter("label <> _old").isEmpty():
            return labels
