"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    return down.join(least, "a").select(
        F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e")
    ).select(F.col("e.x").alias("a"), F.col("e.m").alias("b"))


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, component): the smallest node of its component, for each linked node.

    Every round is a grouped minimum and an equi-join on rows of two integers;
    a hot node's rows are pre-aggregated for the minimum, and the minima are written
    first, so that the join back has nothing but its shuffle on either side and Spark
    can split a hot node's partition.  The rounds end when the edge set repeats; nothing but
    its count and checksum reaches the driver.
    """
    def tidy(edges: DataFrame) -> DataFrame:
        return edges.where("a <> b").distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = materialise(tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    before = state(edges)
    while before[0]:
        edges = materialise(tidy(_small_star(materialise(tidy(_large_star(edges)), "links"))), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
