"""Connected components of links, without any vertex or component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node that links reach) of every node of a link; links are undirected.

    Large-star and small-star steps by turns, until the stars don't change. The minimum of a node's neighbours is
    summed up before it is exchanged, and the joins are on rows of links, so a hub is split like any hot key. Null
    ends and links of a node to itself count for nothing; repeated links are one.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # large star: the larger neighbours of u, and u, join the smallest of all of them
        all_ = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = all_.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = all_.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, join the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
