"""Files that arrive in a folder, extracted as they come; stateless, so no watermark is claimed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import SUFFIXES, extract, numbered, suffix_of

_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    return rows.where(suffix_of(F.col("path")).isin(*SUFFIXES)).select("path", "content", "length")


def extract_to(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch's records, numbered by lower-cased path, as Parquet under its batch number: a batch that runs again replaces its own files."""

    def sink(batch: DataFrame, number: int) -> None:
        extract(numbered(batch, batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = arriving(spark, folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
