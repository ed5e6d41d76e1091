"""Mixing sources to target weights by a time-varying curriculum; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, with_columns_of
from .prefix import running_totals

WORD = r"[^\x20\x09-\x0D]+"
#: Words (about) to a slot of a source's order.
SLOT = 1 << 16
#: No source is repeated more often.
REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest that every engine has: the order of a source's documents."""
    told = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ramps: tuple[float, ...] = (0.5, 1.0, 1.5), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, position, h, passes, extra, start, ramp)``.

    Sources in code-point order (null last) weigh ``weights`` in turn and share all words; a target stops
    at REPEATS times its source's size and the excess is shared again by weight.  A source's documents, in
    the order of a hash, are taken in passes: whole passes first, then as much of one more as the target
    asks; one document a source is cut there.  ``start`` is a document's place in its source's words,
    ``passes`` and ``extra`` how often it is taken whole and how many of its words once more.

    A source's weight over training time ``t`` in [0, 1] is the line ``r + 2 (1 - r) t`` with its ramp
    ``r`` from ``ramps`` in turn; its integral ``r t + (1 - r) t^2`` is the part of the target due by ``t``.
    A document's position inverts that demand at the middle of its words in the first pass;
    ``in_training_order`` range-sorts by it.

    * null or word-less text: size 0, taken 0.  A source without words: target 0.
    * null ids and repeated rows: each row is a document; rows equal in all columns share their place.
    * empty table: empty result.  Extra columns of ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    plain = with_columns_of(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    sized = scratch.save(plain.select("doc_id", "source", word_count(F.col("text")).alias("size"), place_hash(F.col("doc_id"), F.col("text")).alias("h")))
    # a row a source, written first: Spark sees how small it is and hands it out
    target = scratch.save(targets(sized, weights, ramps))
    placed = sized.join(target, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # slots are equal ranges of the hash, as many as each source needs
    slots = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SLOT))
    placed = placed.withColumn("slots", slots).withColumn("slot", F.expr(f"h div ({1 << 60}L div slots + 1)")).drop("slots")
    sums = running_totals(placed.groupBy("source", "slot").agg(F.sum("size").alias("n")), "source", "slot", "n", "before")
    told = sums.select(F.col("source").alias("s"), F.col("slot").alias("p"), "before")
    order = Window.partitionBy("source", "slot").orderBy("h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(told, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("p")))
    start = F.col("before") + F.col("within")
    words = F.least(F.round("target"), REPEATS * F.col("source_size")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), words - passes * F.col("source_size") - start))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + extra).cast("long").alias("taken"),
        training_position(start, F.col("size"), F.col("target"), F.col("ramp")).alias("position"), "h", passes.cast("long").alias("passes"), extra.cast("long").alias("extra"), start.alias("start"), "ramp",
    )


def training_position(start: Column, size: Column, target: Column, ramp: Column) -> Column:
    """When the middle of ``size`` words from word ``start`` of a source's demand is due: ``r t + (1 - r) t^2 = due``."""
    due = F.least(F.lit(1.0), (start + size / 2) / F.greatest(target, F.lit(1.0)))
    # solved so that nothing cancels; at r = 1 it is due itself
    return 2 * due / (ramp + F.sqrt(F.greatest(F.lit(0.0), ramp * ramp + 4 * (1 - ramp) * due)))


def in_training_order(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("position", "h").sortWithinPartitions("position", "h")


def targets(sized: DataFrame, weights: tuple[int, ...], ramps: tuple[float, ...]) -> DataFrame:
    """``(name, source_size, target, ramp)`` of each source of ``sized(source, size)``.

    One row a source meets in one task, never a document.  Filling to capacity in closed form: sources reach their cap in the order of ``cap / weight``, so with
    sources in that order one running sum tells at which level the rest share what is left.
    """
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))
    source = source.select("source", "source_size", turn(weights).cast("double").alias("w"), turn(ramps).cast("double").alias("ramp"))
    source = source.withColumn("cap", F.lit(float(REPEATS)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    by = Window.partitionBy(F.lit(0)).orderBy("level", F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy(F.lit(0))
    source = source.withColumn("filled", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    source = source.withColumn("open", F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    source = source.withColumn("total", F.sum("source_size").over(every).cast("double"))
    here = (F.col("total") - F.col("filled")) / F.col("open")
    # the first source that its share doesn't fill sets the level of all that follow
    source = source.withColumn("share", F.first(F.when(here <= F.col("level"), here), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return source.select(F.col("source").alias("name"), "source_size", F.least(F.col("cap"), F.coalesce("share", "level") * F.col("w")).alias("target"), "ramp")
