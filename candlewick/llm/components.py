"""Connected components of an edge table by alternating large-star and small-star steps, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import stored, unstore


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (the smallest node reachable), for every node of an edge (a, b).  Each round is written to the shared
    folder; only its row count and a checksum reach the driver.  Rounds needed grow with the logarithm of the paths."""
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while (now := _sum(links)) != before:
        before = now
        done = links
        links = stored(_small(_large(links)), label)
        unstore(done)
    # every node now hangs on its smallest one
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _hung(both: DataFrame) -> DataFrame:
    """(u, v, least): least is the smallest of u and its neighbours.  Partial minima and a join, so a hub's links spread."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return both.join(least, "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    return _hung(both).where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = _hung(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    moved = down.select(F.col("v").alias("a"), F.col("least").alias("b")).union(down.select("u", "least"))
    return moved.where("a <> b").distinct()
