"""Connected components of a link table, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for each linked vertex: the smallest vertex that links reach from it.

    Every round takes the smallest label among a vertex's neighbours and then follows labels one step (pointer
    jumping), so stars need one round and chains a number that grows with the logarithm of their length in practice.
    Each round is written to the shared folder, which cuts the lineage. A vertex of very many links is an aggregate with
    map-side combine on one side and a skewed join, which AQE splits, on the other.
    """
    one = links.select(F.col(a).alias("v"), F.col(b).alias("w")).where("v IS NOT NULL AND w IS NOT NULL")
    both = written(one.unionByName(one.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct(), "links")
    labels = written(both.groupBy("v").agg(F.least("v", F.min("w")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near")))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = written(step, "labels")
        onward = step.select(F.col("v").alias("label"), F.col("label").alias("next"))
        labels = written(step.join(onward, "label", "left").select(
            "v", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        moved = labels.where("label <> old").limit(1).count()
        labels = labels.select("v", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
