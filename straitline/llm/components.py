"""Connected components by alternating star contractions, each round a pair of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from straitline.session import checkpointed


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` of each node that a link touches; a component is named by its smallest node.

    Rounds contract chains to stars, so that their number follows the logarithm of the longest chain. Neighbourhoods are
    only ever reduced to their minimum: a node with very many links is summed before the shuffle, and its links are never
    gathered. Links of a node with itself, repeated links and links with a null end change nothing.
    """
    high = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = checkpointed(links.filter(F.col(a) != F.col(b)).select(*high(F.col(a), F.col(b))).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Larger neighbours of a node go to the smallest one around it ...
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # ... then smaller ones and the node itself.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpointed(large.join(small, "u").select(*high(F.col("v"), F.col("m"))).unionByName(small.select("u", F.col("m").alias("v")))
                             .filter("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
