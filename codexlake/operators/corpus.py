"""Sources consolidated into a corpus: metrics, metadata, warnings and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from . import structure
from .ranking import stored

SUSPECT_WORDS = 5000
#: Failures that a message names.
REPORTED = 20


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of equal keys the row that comes first."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def usable(sources: DataFrame) -> DataFrame:
    """Sources with text once invisible characters are gone: ``text`` sanitised, ``removed`` counted."""
    rows = sources.withColumn("removed", T.invisible_count(F.col("text"))).withColumn("text", T.sanitize(F.col("text")))
    return rows.where(F.col("text").isNotNull() & ~T.is_blank(F.col("text")))


def failures(sources: DataFrame) -> DataFrame:
    """``(source_ord, path, message)`` of sources that gave no text."""
    blank = F.col("text").isNull() | T.is_blank(T.sanitize(F.col("text")))
    message = F.coalesce(F.col("error"), F.lit("no text could be extracted")) if "error" in sources.columns else F.lit("no text could be extracted")
    return sources.where(blank).select("source_ord", "path", message.alias("message"))


def consolidate(sources: DataFrame, group: str) -> DataFrame:
    """``(group, n_sources, text, plain)`` from ``sources(group, source_ord, path, filename, text)``.

    ``text`` joins a banner and the text of every source in order and is stripped; ``plain`` has no banners.
    """
    w = F.struct("source_ord", F.concat(T.source_banner(F.col("filename"), F.col("path")), F.col("text")).alias("t"), F.col("text").alias("p"))
    rows = sources.groupBy(group).agg(F.count("*").alias("n_sources"), F.array_sort(F.collect_list(w)).alias("of"))
    joined = T.strip(F.array_join(F.transform("of", lambda x: x["t"]), ""))
    return rows.select(group, "n_sources", joined.alias("text"), F.array_join(F.transform("of", lambda x: x["p"]), "\n\n").alias("plain"))


def _parts(sources: DataFrame, group: str, number: structure.Number) -> DataFrame:
    """What a corpus needs of each source: its own record, counts of its banner and text, its headings' numbers and first lines, its events."""
    piece = F.concat(T.source_banner(F.col("filename"), F.col("path")), F.col("text"))
    cjk, counted = T.cjk_count(F.col("piece")), T.word_count(F.regexp_replace("piece", T.CJK, " "))
    rows = sources.withColumn("piece", piece).withColumn("cjk", cjk).withColumn("words", T.word_count(F.col("piece")))
    rows = rows.withColumn("ls", F.coalesce(T.lines(F.col("text")), F.array().cast("array<string>")))
    rows = rows.withColumn("heads", structure.numbered(F.col("ls"), number))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", rf"^{T.WS}+", ""))
    trail = F.length("piece") - F.length(F.regexp_replace("piece", rf"{T.WS}+\z", ""))
    return rows.select(
        group, "source_ord", F.length("piece").cast("long").alias("chars"), lead.cast("long").alias("lead"), trail.cast("long").alias("trail"), "words", "cjk",
        F.when(F.col("cjk") == 0, F.col("words")).otherwise(counted).alias("latin"), F.size("ls").cast("long").alias("n_lines"),
        F.array_distinct(F.transform("heads", lambda h: h["number"])).alias("numbers"),
        F.transform(F.slice("heads", 1, structure.SAMPLE), lambda h: F.struct(F.col("source_ord").alias("source_ord"), h["line_no"].alias("line_no"), h["s"].alias("s"))).alias("first"),
        F.when(F.size("heads") == 0, structure.events(F.col("ls"))).alias("events"), H.has_toc(F.col("text")).alias("has_toc"), F.col("size_bytes").alias("bytes"),
        F.struct(
            "source_ord", "path", "filename", "format", "method", T.size_mb(F.col("size_bytes")).alias("size_mb"), "pages", "images_dropped",
            F.length("text").alias("chars"), T.word_count(F.col("text")).alias("words"), T.estimate_tokens(F.col("text")).alias("estimated_tokens"),
        ).alias("source"),
    )


def _numeric(parts: DataFrame, group: str) -> DataFrame:
    """``(group, numeric, chapter_headings_sample)`` of the corpora with numbered chapters; numbers are below a thousand."""
    each = parts.select(group, F.explode("numbers").alias("number")).groupBy(group).agg(F.countDistinct("number").alias("numeric"))
    # the first headings of a corpus are among the first of its first sources with any
    w = Window.partitionBy(group).orderBy("source_ord")
    some = parts.where(F.size("first") > 0).select(group, "source_ord", "first").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= structure.SAMPLE)
    sample = some.groupBy(group).agg(F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, structure.SAMPLE).alias("f"))
    return each.join(sample, group).select(group, "numeric", F.transform("f", lambda x: x["s"]).alias("chapter_headings_sample"))


def _structural(parts: DataFrame, numeric: DataFrame, group: str) -> DataFrame:
    """``(group, structural)`` of the other corpora, from the events of their sources; a blank line stands between two sources."""
    w = Window.partitionBy(group).orderBy("source_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.join(numeric.select(group), group, "left_anti").select(group, "source_ord", "events", F.coalesce(F.sum(F.col("n_lines") + 1).over(w), F.lit(0)).alias("offset"))
    moved = F.transform("events", lambda e: F.struct((e["line_no"] + F.col("offset")).alias("line_no"), *(e[c].alias(c) for c in ("s", "prev", "own", "gap"))))
    whole = rows.select(group, moved.alias("events")).groupBy(group).agg(F.array_sort(F.flatten(F.collect_list("events"))).alias("events"))
    return whole.select(group, structure.structural_count(structure.depth_table(structure.headings_of(F.col("events")))).alias("structural"))


def metadata(sources: DataFrame, group: str, number: structure.Number = H.stripped_chapter_number) -> DataFrame:
    """One row a corpus: totals of the consolidated text, structure across sources, and an array of its sources.

    ``sources(group, source_ord, path, filename, format, method, size_bytes, pages, images_dropped, text)``.
    The consolidated text itself is never made: counts are sums over sources and their banners, numbered
    chapters are gathered by number, and headings by depth from the few lines that may be some.  ``number`` as in ``structure.numbered``.
    """
    parts = stored(_parts(sources, group, number))  # texts are read once
    numeric = _numeric(parts, group)
    structural = _structural(parts, numeric, group)
    ends = F.min_by("lead", "source_ord") + F.max_by("trail", "source_ord")
    measured = parts.groupBy(group).agg(
        F.count("*").alias("n_sources"), (F.sum("chars") - ends).alias("chars"), F.sum("words").alias("words"),
        F.floor(F.sum("latin") / F.lit(T.WORDS_PER_TOKEN) + F.sum("cjk") / F.lit(T.CJK_PER_TOKEN)).cast("long").alias("estimated_tokens"),
    )
    one = lambda c, many: F.when(F.count("*") > 1, F.lit(many)).otherwise(F.first(f"source.{c}"))
    totals = parts.groupBy(group).agg(
        one("filename", "multi-source").alias("filename"), one("format", "mixed").alias("format"), one("method", "multi-method").alias("extraction_method"),
        T.size_mb(F.sum("bytes")).alias("file_size_mb"), F.sum("source.pages").alias("pages"), F.sum(F.coalesce("source.images_dropped", F.lit(0))).alias("images_dropped"),
        F.bool_or("has_toc").alias("has_toc"), F.array_sort(F.collect_list("source")).alias("sources"),
    )
    rows = measured.join(totals, group).join(numeric, group, "left").join(structural, group, "left")
    n = F.coalesce("numeric", "structural", F.lit(0))
    method = F.when(F.col("numeric") > 0, "numeric").when(n > 0, "structural").otherwise("none")
    rows = rows.withColumn("chapters_detected", n.cast("long")).withColumn("chapters_method", method).drop("numeric", "structural")
    rows = rows.withColumn("chapter_headings_sample", F.coalesce("chapter_headings_sample", F.array().cast("array<string>")))
    suspect = (F.col("chapters_method") == "structural") & (F.col("chapters_detected") <= 1) & (F.col("words") > SUSPECT_WORDS)
    return rows.withColumn("chapter_detection_suspect", suspect).withColumn("no_toc", ~F.col("has_toc"))


def write_corpus(sources: DataFrame, group: str, path: str) -> None:
    """``full_text`` and ``metadata`` folders, the latter a row a corpus; fails if the folder is there already.

    A corpus' text is a folder of files in order, and its files' lines in order are its text: sources are
    range-sorted, and no row is longer than its source.
    """
    edge = Window.partitionBy(group)
    light = sources.select(group, "source_ord").withColumn("lo", F.min("source_ord").over(edge)).withColumn("hi", F.max("source_ord").over(edge))
    rows = sources.select(group, "source_ord", F.concat(T.source_banner(F.col("filename"), F.col("path")), F.col("text")).alias("t")).join(light, [group, "source_ord"])
    # the line end that the writer puts after a row stands for the first one of the next
    t = F.when(F.col("source_ord") == F.col("lo"), F.regexp_replace("t", rf"^{T.WS}+", "")).otherwise(F.expr("substr(t, 2)"))
    t = F.when(F.col("source_ord") == F.col("hi"), F.regexp_replace(t, rf"{T.WS}+\z", "")).otherwise(t)
    rows = rows.select(group, "source_ord", t.alias("text")).repartitionByRange(group, "source_ord").sortWithinPartitions(group, "source_ord")
    rows.select(group, "text").write.partitionBy(group).text(f"{path}/full_text")
    metadata(sources, group).write.json(f"{path}/metadata")
