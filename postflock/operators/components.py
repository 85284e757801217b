"""Connected components by least-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postflock.session import cut_lineage


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label), the label being the least id of the component. ``edges(src, dst)`` must hold
    both directions. Each round is one aggregate and one join, checkpointed to the shared folder."""
    edges = cut_lineage(edges.select("src", "dst"))
    labels = cut_lineage(nodes.select("id", F.col("id").alias("label")))
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    while before is not None:
        near = (
            edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst")
            .groupBy(F.col("src").alias("id")).agg(F.min("label").alias("_near"))
        )
        step = labels.join(near, "id", "left").select(
            "id", F.least("label", F.coalesce("_near", "label")).alias("label")
        )
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("_root"))
        labels = cut_lineage(
            step.join(jump, "label").select("id", F.col("_root").alias("label"))
        )
        after = labels.agg(total).first()[0]
        if after == before:
            break
        before = after
    return labels
