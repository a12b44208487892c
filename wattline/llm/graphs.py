"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline.session import settle


def components(edges: DataFrame) -> DataFrame:
    """node, component for every end of ``edges`` (a, b): component is the smallest node that can be reached.

    Each round takes the smallest label among neighbours and then the label of the label, so a
    chain shortens by half; rounds go on until nothing changes. Labels of each round are stored
    in the shared folder, from which a lost executor's part is read again.
    """
    spark = edges.sparkSession
    both = settle(
        spark,
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = settle(
        spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("nearest"))
        )
        hooked = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "nearest").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = settle(
            spark,
            hooked.join(jump, "component").select(
                "node", "old", F.least("component", "further").alias("component")
            ),
            "labels",
        )
        changed = step.where("old != component").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
