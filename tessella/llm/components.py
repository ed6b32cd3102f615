"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to (node, component), the component being its smallest node.

    Large-star and small-star steps (Kiveris and others, 2014) hang neighbours on smaller ones
    until nothing changes; a node's minimum is aggregated before the shuffle, and edges, not
    groups, meet it in a join, so a node with very many neighbours doesn't gather them. Loops,
    repeated edges and edges with a null end change nothing. Nodes without an edge aren't listed.
    """
    now = common.saved(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = common.saved(small.where("a <> b").distinct())
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == state:
            break
        state = (seen.n, seen.s)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
