"""Numbers of rows in an order, over any number of rows: no window ever has all of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOW = (1 << 33) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codexlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and every use sees the same rows."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``name``: its number from 1 in ``order``, within ``by``.

    Rows are range-sorted by both, so those of one group stand together, and a large group lies in several
    partitions.  A row's number is its partition's offset, a sum over one row a partition, and its place
    there; within ``by``, less that of its group's first.
    """
    by = by or []
    cols = [F.col(c) for c in (*by, *order)]
    got = stored(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    # one row a partition: the sum before it runs over as few rows as there were tasks
    counts = got.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.agg(F.array_sort(F.collect_list(F.struct("_p", "_n"))).alias("c"))
    before = before.select(F.explode(F.transform("c", lambda x, i: F.struct(x["_p"].alias("_p"), F.aggregate(F.slice("c", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["_n"]).alias("_before")))).alias("b")).select("b.*")
    got = got.withColumn("_p", part).join(before, "_p").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(_LOW)) + 1).drop("_p", "_id", "_before")
    if not by:
        return got
    first = got.groupBy(*by).agg((F.min(name) - 1).alias("_first"))
    renamed = first.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_first")
    same = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        same = one if same is None else same & one
    return got.join(renamed, same).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *(f"_by_{c}" for c in by))
