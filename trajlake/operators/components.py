"""Connected components of links, and of the pairs (oid, hid) that meet in a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, kept


def components(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, v and component (its smallest reachable v) of every end of links (keys, a, b); each key is a graph of its own.

    Alternating large-star and small-star steps; each turns a node's edges to its smallest neighbour, until all edges are
    stars: a number of rounds that grows with the logarithm of the longest chain. Both sides of the join are plain tables,
    so that Spark splits the partitions of hub nodes.
    """
    keys = keys or []
    edges = kept(links.filter("a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    stars = edges.isEmpty()
    while not stars:
        for step in ("large", "small"):
            both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))) if step == "large" else edges
            least = kept(both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
            joined = both.join(least, [*keys, "u"])
            if step == "large":
                turned = joined.filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                turned = joined.filter("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(*keys, "u", F.col("m").alias("v")))
            turned = kept(turned.distinct(), "edges")
            drop(edges, least)
            edges = turned
        # not yet while a parent has a parent itself, nor while a node has two
        stars = edges.join(edges.select(*keys, F.col("u").alias("v")), [*keys, "v"], "left_semi").isEmpty() and edges.groupBy(*keys, "u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo < hi").isEmpty()
    return edges.select(*keys, F.col("u").alias("v"), F.col("v").alias("component")).unionByName(edges.select(*keys, "v", F.col("v").alias("component")).distinct())


def pair_components(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, oid, hid and a number for their component. Objects are even nodes and predictions odd ones; the table of links has
    a row for each pair that meets, not for each frame."""
    met = kept(pairs.select(*keys, "oid", "hid").distinct(), "met")
    if met.groupBy(*keys, "hid").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # each object is a component
        return met.withColumn("component", F.col("oid") * 2)
    labels = components(met.select(*keys, (F.col("oid") * 2).alias("a"), (F.col("hid") * 2 + 1).alias("b")), keys)
    return met.join(labels.filter("v % 2 = 0").select(*keys, F.expr("v div 2").alias("oid"), "component"), [*keys, "oid"])
