"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a and b, long): component is the smallest node reachable.

    Each round joins the edges with every node's smallest neighbour and is pinned in the shared folder. The smallest
    neighbours (partly aggregated before their shuffle) are pinned too, so that the joins have shuffles of their own, which Spark
    splits where a hub has many edges; no neighbour list is ever gathered. Nothing reaches the
    driver but one count and one checksum a round. Nulls, loops and repeated edges are ignored; an empty
    table gives an empty result.
    """
    now = pinned(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pinned(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = pinned(large)
        low = pinned(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = pinned(small.select("e.a", "e.b").where("a > b").distinct())
        before, seen = seen, _signature(now)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def component_least(parts: DataFrame, least: DataFrame) -> DataFrame:
    """(node, component, linked, component_least) for each node of ``parts`` (node, component): the smallest ``least`` (node, least) of its component, null if all are.

    The smallest are pinned, so that the join on component has a shuffle of its own for either side: Spark splits that of a
    large component.
    """
    members = pinned(parts.join(least, "node"))
    smallest = pinned(members.groupBy("component").agg(F.min("least").alias("component_least")))
    return members.join(smallest, "component").select("node", "component", F.lit(True).alias("linked"), "component_least")
