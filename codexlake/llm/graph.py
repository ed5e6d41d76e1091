"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reached.

    Every step is a grouped minimum (combined before the shuffle) and an equi-join that adaptive
    execution can split, so a hub with most of the edges is no single task.  The edge table is written
    after each round, which bounds lineage; rounds grow with the logarithm of a component's diameter.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = scratch.save(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        new = scratch.save(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        after = _state(new)
        scratch.drop(now)
        now = new
        if after == state:
            break
        state = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table: one row."""
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("lo"), F.sum(F.shiftrightunsigned(h, 32)).alias("hi")).first()
    return r["n"], r["lo"], r["hi"]
