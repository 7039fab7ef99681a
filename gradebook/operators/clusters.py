"""Connected clusters of a link table by rounds of smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored_table


def clusters(links: DataFrame) -> DataFrame:
    """``node, label`` (the cluster's smallest node) of every node of ``links`` (a, b).

    In each round a node takes the smallest label among itself and its neighbours (a partial
    aggregate, no neighbour list is gathered) and then its label's own label, so the number of
    rounds grows with the logarithm of a cluster's width in practice. Every round is a stored
    table: lineage is cut and a lost executor costs one round.
    """
    both = stored_table(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored_table(both.select(F.col("a").alias("node")).distinct().withColumn(
        "label", F.col("node")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").withColumn("least", F.least("label", "near"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("next"))
        after = stored_table(least.join(jump, "least").select(
            "node", F.least("least", "next").alias("label"),
            (F.col("label") > F.least("least", "next")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels
