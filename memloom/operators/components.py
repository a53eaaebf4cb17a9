"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``node`` and ``component`` (its smallest node), for every node of an edge.

    Labels take the minimum over neighbours, then over the label's own label,
    until none changes. Each round is checkpointed, so lineage stays short.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct()
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, "u").groupBy("v").agg(F.min("label").alias("m")).withColumnRenamed("v", "u")
        step = labels.join(near, "u").select("u", F.least("label", "m").alias("l"), F.col("label").alias("old"))
        jump = labels.select(F.col("u").alias("l"), F.col("label").alias("deeper"))
        new = cut(step.join(jump, "l", "left").select("u", F.least("l", F.coalesce("deeper", "l")).alias("label"), "old"))
        if not new.where("label <> old").limit(1).count():
            return new.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = new.select("u", "label")
