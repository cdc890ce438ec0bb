"""Connected components of a graph given as a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialised


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node of it) for each node of ``links`` (``a``, ``b``).

    Rounds of large-star and small-star: each moves every node's greater, then smaller, neighbours to the least one, until
    every link leads to a component's least node. The rounds grow with the logarithm of the longest path, and no round
    brings a node's neighbours together: both are a minimum per node and a join.
    """
    edges = materialised(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = e.join(least, "u")
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while True:
        edges = materialised(star(star(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
