"""Connected components of a graph of links, by alternating large-star and small-star steps.

Nothing of the graph goes to the driver but the number of changed links. Every step is a shuffle on node ids,
with minima combined before it, so a node with very many links is no hot task: its smallest neighbour is an
aggregate and is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at the node's smallest neighbour (or itself)."""
    if large:
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = ways.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of comparable ids -> (node, component): the smallest id reachable, for every node with a link."""
    links = stored(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    signature = None
    while True:
        links = stored(_star(_star(links, True), False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == signature:
            break
        signature = tuple(now)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
