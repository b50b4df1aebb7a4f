"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges: pairs of longs. Returns node, component (its smallest node) for every node of an edge.

    Each node passes its smallest neighbour on to its other neighbours, larger ones and smaller ones in turn; about
    log(n) rounds leave stars around the smallest nodes. A node with very many neighbours is the skewed side of a join,
    which Spark splits; its neighbours are never gathered.
    """
    e = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        e = cut(small.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    stars = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
