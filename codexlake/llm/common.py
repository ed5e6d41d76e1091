"""What the operators share: tables kept in the cluster's shared folder, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to numpy at once; a single longer text is still handled, alone.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one of our own, on one machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="codexlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs a re-read of these files, never a recomputation of what came before.  Tables
    that nothing reads any more are dropped at once; those behind a returned frame when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self.clear)

    def save(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)  # type: ignore[attr-defined]

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; the folder's own retention removes the files
            return

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def row_slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of ``column`` each, a row at least."""
    if batch.num_rows == 0:
        return
    sizes = batch.column(column)
    lengths = np.array([0 if x is None else x for x in pc.binary_length(sizes).to_pylist()], np.int64)
    block = (np.cumsum(lengths) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def starts_of(lengths: Iterable[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int64)


def lists(flat: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat, kind))


def with_columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns never meet an operator's own."""
    return docs.select(*(F.col(f"`{n}`") for n in names))
