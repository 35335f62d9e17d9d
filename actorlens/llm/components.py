"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actorlens.sources.storage import checkpointed


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours. Both only pair a node with a minimum, so the number
    of links never grows, and a hub is combined before its shuffle. Fails if ``rounds`` are too few.
    """
    edges = checkpointed(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.filter("u <> v").distinct())
        lowest = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u")
        edges = checkpointed(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
