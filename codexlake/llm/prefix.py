"""Running totals by key over numbered slots, without one task for all slots of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots to a block: a block is one window partition, and so are the blocks of a key.
BLOCK = 1024


def running_totals(df: DataFrame, key: str | Column, slot: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the smaller slots of the same key.

    ``df`` has one row for each key and slot.  Totals of blocks of BLOCK slots run first, then slots within
    their block, so a key with many slots is spread over its blocks.
    """
    k = F.col(key) if isinstance(key, str) else key
    rows = df.withColumn("_k", k).withColumn("_b", F.floor(F.col(slot) / BLOCK))
    block = rows.groupBy("_k", "_b").agg(F.sum(value).alias("_t"))
    before = F.sum("_t").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    block = block.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_k", "_b").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_within", F.coalesce(within, F.lit(0)))
    rows = rows.join(block, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_b2")))
    return rows.withColumn(name, F.col("_before") + F.col("_within")).drop("_k", "_b", "_k2", "_b2", "_before", "_within")
