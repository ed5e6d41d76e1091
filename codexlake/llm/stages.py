"""Stages of the corpus pipeline: each applies one operator's decisions to the documents it is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .minhash import minhash_dedup
from .mixing import in_training_order, mix, place_hash, training_position
from .packing import pack, public_tokenizer
from .quality import classify
from .suffix import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def run(stages: list[tuple[str, Stage]], spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows but the last's are written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(stages):
            docs = scratch.save(docs)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, five-word shingles at a similarity of 0.8 or more, stays: the smallest id, once.

    Rows are told apart by id and text, so rows that repeat an id with other texts are documents of their
    own.  Documents without an id can't be told apart and stay.
    """
    docs = docs.select(*COLUMNS)
    rows = docs.where("doc_id is not null").withColumn("_row", F.xxhash64("doc_id", "text"))
    found = minhash_dedup(rows, percent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id").distinct()
    first = rows.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("r"))
    kept = rows.join(first.select("r._row"), "_row", "left_semi").dropDuplicates(["_row"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; ``labels`` of the same folder are learned from.

    A row is found again by its id and a hash of its text, so rows that repeat an id are told apart.
    """
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    marked = classify(keyed, labels, host=F.col("source"), path=F.col("lang"), id_col="_row", label_id=F.col("doc_id"))
    gone = marked.where("not kept").select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(gone, "_row", "left_anti").select(*COLUMNS)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings are cut out of the texts; every document stays, perhaps with an empty text."""
    return suffix_dedup(docs.select(*COLUMNS), with_text=True, carry=("lang", "source")).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars")
    )


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, in training order; of a last cut copy its first words."""
    docs = docs.select(*COLUMNS)
    plan = mix(docs).where("taken > 0").dropDuplicates(["doc_id", "h"])
    key = place_hash(F.col("doc_id"), F.col("text"))
    plan = plan.select(F.col("doc_id").alias("_id"), "h", "size", "source_size", "target", "passes", "extra", "start", "ramp")
    whole = docs.withColumn("_h", key).join(plan, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")))
    turns = F.col("passes") + (F.col("extra") > 0).cast("long")
    copies = whole.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), turns)))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    last = F.col("turn") > F.col("passes")
    text = F.when(last & (F.col("extra") < F.col("size")), F.array_join(F.slice(words, 1, F.col("extra").cast("int")), " ")).otherwise(F.col("text"))
    place = training_position(F.col("start") + (F.col("turn") - 1) * F.col("source_size"), F.col("size"), F.col("target"), F.col("ramp"))
    copies = copies.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).withColumn("position", place)
    return in_training_order(copies).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed with each source in training order; ``row`` tells the copies of a document apart."""
    return pack(docs, public_tokenizer(), order=written_order(docs))


def written_order(docs: DataFrame) -> tuple[Column, ...]:
    """Where a row stands in the files that ``docs`` was written to; nothing for tables that are no files.

    The mixing stage writes its rows range-sorted by training position and can't return the position as a
    column, so the order of its files and of the rows in them is what it hands on.
    """
    name = F.col("_metadata.file_name")
    try:
        docs.select(name, "_metadata.row_index")
    except AnalysisException:
        return ()
    return F.coalesce(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.lit(0)), name, F.col("_metadata.row_index")
