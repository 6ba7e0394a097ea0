"""Connected components of a graph given by its edges, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bitmap import split_join
from quern.session import durable


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of ``edges`` (a, b; either order, repeats, loops and nulls don't matter).

    Large-star and small-star steps in turn until nothing changes: every step
    joins a node's edges with the least of its neighbours, so no neighbourhood
    is ever collected, and a node with very many edges is split. The number of
    rounds grows with the logarithm of the longest chain. Each round is
    written to the shared folder.
    """
    given = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("low") < F.col("high"))).distinct()
    nodes = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).where(F.col("node").isNotNull()).distinct())
    given, last = durable(given), None
    while True:
        # large star: of every node its greater neighbours go to the least of all
        both = given.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(given.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = split_join(both, least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("low"), F.col("v").alias("high")).where("low < high").distinct()
        large = durable(large)
        # small star: of every node its lesser neighbours and itself go to the least
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = split_join(large, least, "high")
        small = joined.select(F.col("m").alias("low"), F.col("low").alias("high")).unionByName(least.select(F.col("m").alias("low"), "high")).where("low < high").distinct()
        given = durable(small)
        now = given.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return nodes.join(given.select(F.col("high").alias("node"), F.col("low").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
