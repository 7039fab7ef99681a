"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges ``hi > lo``.

    Both take the minimum neighbour of each node by a partial aggregate and join it back, so
    no neighbour list is ever gathered.
    """
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(
        "hi", F.least("hi", "m").alias("m"))
    large = both.join(least, "hi").where(F.col("lo") > F.col("hi")).select(
        F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
    small = large.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = large.join(small, "hi").where(F.col("lo") != F.col("m")).select(
        F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(small.select("hi", F.col("m").alias("lo"))).distinct()


def _finished(edges: DataFrame) -> bool:
    """Whether every component is a star: no node is the higher end of two edges, or the higher
    end of one edge and the lower end of another. The centre is then its smallest node."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )).alias("e")).select("e.*")
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where(F.col("up") + F.col("down") > 1).where("up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (the component's smallest node) of every node of ``edges`` (a, b).

    The rounds end when all components are stars; their number grows with the logarithm of
    the longest path, squared at worst. Every round is a stored table, so lineage is cut.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while not _finished(edges):
        edges = stored(_stars(edges), "stars")
        release(edges.sparkSession)
    labels = edges.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct()
