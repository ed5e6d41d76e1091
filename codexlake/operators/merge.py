"""Folding new chapters into what exists: glossaries, indexes, numbering; budgets and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked

# Tokens of a chapter by kind of book and depth, caps of the other files, prices of a run.
BUDGETS = (("text", "reference", 800, 1200), ("text", "study", 1000, 1800), ("technical", "reference", 1200, 1800), ("technical", "study", 2000, 3000))
CAPS = {"glossary": 1500, "patterns": 2000, "patterns_merged": 2500, "cheatsheet": 1200, "master": 4000}
INPUT_FACTOR, CHAPTER_OUT, FIXED_OUT = 1.3, {"text": 1000, "technical": 1800}, 4000 + 4500
ANALYSIS_WINDOW = 8000


def merge_references(old: DataFrame, new: DataFrame, term: str = "term", ref: str = "ref") -> DataFrame:
    """``(term, refs)`` of both in alphabetical order; a term of both has the references of both, in order and once."""
    both = old.select(term, ref).unionByName(new.select(term, ref))
    return both.groupBy(term).agg(F.array_sort(F.collect_set(ref)).alias("refs")).orderBy(F.lower(term), term)


def number_new(existing: DataFrame, new: DataFrame, order: str, number: str = "number", by: str | None = None) -> DataFrame:
    """``new`` numbered on from the highest number of ``existing``, in ``order`` (within ``by``)."""
    part = [by] if by else []
    last = existing.groupBy(*part).agg(F.max(number).alias("_last"))
    rows = ranked(new, [order], number, part)
    if by:
        last = last.withColumnRenamed(by, "_by")
        rows = rows.join(last, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    else:
        rows = rows.join(last, F.lit(True), "left")  # one row
    return rows.withColumn(number, F.coalesce("_last", F.lit(0)) + F.col(number)).drop("_last")


def preflight(tokens: Column, chapters: Column, kind: str) -> tuple[Column, Column]:
    """Tokens in and out of generating a book's files."""
    return F.floor(tokens * F.lit(INPUT_FACTOR) + F.lit(1e-9)).cast("long"), (chapters * CHAPTER_OUT[kind] + FIXED_OUT).cast("long")


def depth_of(choice: Column) -> Column:
    return F.when(choice == 3, "reference").otherwise("study")


def over_budget(kind: Column, tokens: Column) -> Column:
    caps = F.create_map(*(F.lit(x) for kv in CAPS.items() for x in kv))
    return tokens > F.element_at(caps, kind)


def analysis_window(text: Column) -> Column:
    return F.substring(text, 1, ANALYSIS_WINDOW)
