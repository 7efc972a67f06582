"""Connected components of an edge table, in rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 64, name: str = "cc") -> DataFrame:
    """Label every node of ``edges`` (src, dst: long) with the smallest node it can reach.

    Returns ``node, component`` for nodes that have an edge to another node; a node without one is its
    own component and is left to the caller. Each round links every node to the smallest node of its
    neighbourhood; the number of rounds grows with the logarithm of the longest path. Every round is
    written to the shared folder. Null ends and self loops are ignored; an empty table gives an empty
    one. A node with very many edges is pre-aggregated by the minimum before the shuffle; minima are written before they
    are joined, as adaptive execution splits a very common node only in a join of two tables.
    """
    pairs = edges.where("src is not null and dst is not null and src <> dst").select(
        F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")
    )
    now = scratch.keep(pairs.distinct(), f"{name}_0", narrow=True)
    last = None
    for step in range(1, max_rounds + 1):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}_least", narrow=True)
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.keep(large, f"{name}_large", narrow=True)
        floor = scratch.keep(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), f"{name}_floor", narrow=True)
        small = large.withColumnRenamed("hi", "u").join(floor, "u").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = scratch.keep(small.union(floor.select("u", "m")).distinct(), f"{name}_{step}", narrow=True)
        mark = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        scratch.drop(f"{name}_{step - 1}")
        now = after
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
