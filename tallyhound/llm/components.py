"""Connected components of an edge table by alternating large and small stars.

Each half-round joins the edges with one minimum a node; hot nodes are split by adaptive joins and their
minima combined before they move. Nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.staging import stage


def _ordered(edges: DataFrame, u, v) -> DataFrame:
    return edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node of its component) of every node that isn't a root."""
    stars, before = stage(_ordered(edges, F.col(a), F.col(b)), "edges"), None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _ordered(both.join(least, "u").filter("v > u"), F.col("v"), F.col("m"))
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = stage(_ordered(small.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")), F.col("v"), F.col("m")), "small-star")
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
