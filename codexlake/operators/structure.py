"""Structure of documents from their lines: numbered chapters, headings by depth, segments.

A document's lines are one array in its row, and all that belongs to one document is found there, by
functions over arrays: no line is ever shuffled, and texts are not either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T

#: The chapter number of a stripped line, null of one that is no heading.
Number = Callable[[Column], Column]

#: Numbered titles of one depth count as chapters from so many, with so many characters of body in the median.
LEAST_TITLES, LEAST_BODY = 3, 200
SAMPLE = 10
DEPTHS = 6


def line_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """``(key, ls)``: the lines of each document; none of a null text."""
    return docs.select(key, F.coalesce(T.lines(F.col(text)), F.array().cast("array<string>")).alias("ls"), *more)


def _indexed(ls: Column) -> Column:
    return F.transform(ls, lambda x, i: F.struct(i.alias("line_no"), x.alias("raw")))


def numbered(ls: Column, number: Number = H.stripped_chapter_number) -> Column:
    """Chapter headings among lines: ``array<struct<line_no, s, number>>``; ``number`` may tell fewer lines for headings than the default."""
    # most lines end at this test, before they are even stripped
    some = F.transform(F.filter(_indexed(ls), lambda x: H.maybe_chapter(x["raw"])), lambda x: F.struct(x["line_no"].alias("line_no"), T.strip(x["raw"]).alias("s")))
    told = F.transform(some, lambda x: F.struct(x["line_no"].alias("line_no"), x["s"].alias("s"), number(x["s"]).alias("number")))
    return F.filter(told, lambda x: x["number"].isNotNull())


def chapter_count(heads: Column) -> Column:
    return F.size(F.array_distinct(F.transform(heads, lambda h: h["number"]))).cast("long")


def fenced_spans(marks: Column) -> Column:
    """Closed fences of ``array<struct<line_no, ch>>`` in line order: ``array<struct<a, z>>``.

    A fold: a marker opens, the next of the same character closes, and one that is never closed masks
    nothing, though it has passed over markers of the other kind.
    """
    start = F.struct(F.lit(None).cast("string").alias("ch"), F.lit(0).cast("long").alias("a"), F.array().cast("array<struct<a:bigint,z:bigint>>").alias("spans"))

    def step(s: Column, m: Column) -> Column:
        closes = s["ch"] == m["ch"]
        span = F.array(F.struct(s["a"].alias("a"), m["line_no"].alias("z")))
        return (
            F.when(s["ch"].isNull(), F.struct(m["ch"].alias("ch"), m["line_no"].alias("a"), s["spans"].alias("spans")))
            .when(closes, F.struct(F.lit(None).cast("string").alias("ch"), F.lit(0).cast("long").alias("a"), F.concat(s["spans"], span).alias("spans")))
            .otherwise(s)
        )

    return F.aggregate(marks, start, step, lambda s: s["spans"])


def events(ls: Column) -> Column:
    """The few lines that begin like a heading, an underline or a fence, and what headings need of the lines between:
    ``array<struct<line_no, s, prev, own, gap>>``.

    ``prev``: the stripped line before, ``own``: characters of the line, ``gap``: of those since the event before.
    A last event, an empty line past the end, has what follows the others.
    """

    def one(lines: Column, sizes: Column, few: Column, i: Column, k: Column) -> Column:
        since = F.coalesce(F.get(few, k - 1), F.lit(-1)) + 1
        gap = F.aggregate(F.slice(sizes, since + 1, i - since), F.lit(0).cast("long"), lambda a, x: a + x)
        inside = i < F.size(lines)
        return F.struct(
            i.cast("long").alias("line_no"), F.when(inside, T.strip(F.get(lines, i))).otherwise("").alias("s"), F.when(i > 0, T.strip(F.get(lines, i - 1))).otherwise("").alias("prev"),
            F.when(inside, F.get(sizes, i)).otherwise(0).alias("own"), gap.alias("gap"),
        )

    few = lambda lines: F.concat(F.transform(F.filter(_indexed(lines), lambda x: x["raw"].rlike(H.MARKED)), lambda x: x["line_no"]), F.array(F.size(lines)))
    sizes = lambda lines: F.transform(lines, lambda x: F.length(x))
    return T.let(ls, lambda lines: T.let(sizes(lines), lambda n: T.let(few(lines), lambda at: F.transform(at, lambda i, k: one(lines, n, at, i, k)))))


def headings_of(found: Column) -> Column:
    """ATX, AsciiDoc and underlined headings outside fences among ``events``: ``array<struct<line_no, depth, title, numbered, body>>``.

    An underlined heading stands at its underline.  ``body``: characters of the lines up to the next
    heading, line ends not counted.
    """
    marks = lambda e: F.transform(F.filter(e, lambda x: x["s"].rlike(H.FENCE)), lambda x: F.struct(x["line_no"].alias("line_no"), F.substring(x["s"], 1, 1).alias("ch")))
    return T.let(found, lambda e: T.let(fenced_spans(marks(e)), lambda spans: T.let(_titles(e, spans), lambda heads: _with_bodies(e, heads))))


def headings(ls: Column) -> Column:
    return headings_of(events(ls))


def _titles(found: Column, spans: Column) -> Column:
    fenced = lambda i: F.exists(spans, lambda p: (p["a"] <= i) & (i <= p["z"]))
    told = F.transform(
        found,
        lambda x, k: F.struct(
            k.alias("k"), x["line_no"].alias("line_no"), x["s"].alias("s"), F.regexp_extract(x["s"], H.ATX, 1).alias("mark"), F.lower(T.strip(F.regexp_extract(x["s"], H.ATX, 2))).alias("title"),
            F.when(x["s"].rlike(H.UNDERLINE), x["prev"]).otherwise("").alias("prev"),
        ),
    )
    plain = lambda x: (x["prev"] != "") & ~x["prev"].rlike(H.ATX) & ~x["prev"].rlike(H.UNDERLINE) & ~fenced(x["line_no"] - 1)
    under = lambda x: plain(x) & (F.length(x["s"]) >= F.length(x["prev"]))
    kept = F.filter(F.filter(told, lambda x: under(x) | ((x["mark"] != "") & x["title"].rlike(H.WORD))), lambda x: ~fenced(x["line_no"]))
    head = lambda x, depth, title, numbered_: F.struct(x["k"].alias("k"), x["line_no"].alias("line_no"), depth.alias("depth"), title.alias("title"), numbered_.alias("numbered"))
    return F.transform(
        kept,
        lambda x: F.when(x["prev"] != "", head(x, F.when(x["s"].startswith("="), 1).otherwise(2), F.lower(x["prev"]), F.lit(False))).otherwise(
            head(x, F.length(x["mark"]), x["title"], x["title"].rlike("^" + H.DIGIT))
        ),
    )


def _with_bodies(found: Column, heads: Column) -> Column:
    def whole(h: Column, j: Column) -> Column:
        end = F.coalesce(F.get(heads, j + 1)["k"], F.size(found))
        between = F.aggregate(F.slice(found, h["k"] + 2, end - h["k"] - 1), F.lit(0).cast("long"), lambda a, x: a + x["own"] + x["gap"])
        body = between + F.coalesce(F.get(found, end)["gap"], F.lit(0))
        return F.struct(*(h[c].alias(c) for c in ("line_no", "depth", "title", "numbered")), body.alias("body"))

    return F.transform(heads, whole)


def depth_table(heads: Column) -> Column:
    """Of each depth: ``array<struct<depth, n_titles, median_body, structural, titles>>``.

    ``n_titles`` and ``median_body`` are of the titles that begin with a digit, ``structural`` whether these
    count; ``titles`` is the number of distinct titles that count.
    """

    def one(all_: Column, d: Column) -> Column:
        of = F.filter(all_, lambda h: h["depth"] == d)
        return F.struct(d.alias("depth"), of.alias("of"), F.array_sort(F.transform(F.filter(of, lambda h: h["numbered"]), lambda h: h["body"])).alias("bodies"))

    def judged(t: Column) -> Column:
        n = F.size(t["bodies"])
        median = (F.get(t["bodies"], F.floor((n - 1) / 2).cast("int")) + F.get(t["bodies"], F.floor(n / 2).cast("int"))) / 2
        return F.struct(t["depth"].alias("depth"), t["of"].alias("of"), n.cast("long").alias("n_titles"), median.alias("median_body"), ((n >= LEAST_TITLES) & F.coalesce(median >= LEAST_BODY, F.lit(False))).alias("structural"))

    def counted(t: Column) -> Column:
        titles = F.size(F.array_distinct(F.transform(F.filter(t["of"], lambda h: ~h["numbered"] | t["structural"]), lambda h: h["title"])))
        return F.struct(*(t[c].alias(c) for c in ("depth", "n_titles", "median_body", "structural")), titles.cast("long").alias("titles"))

    return T.let(heads, lambda all_: F.transform(F.transform(F.transform(F.sequence(F.lit(1), F.lit(DEPTHS)), lambda d: one(all_, d)), judged), counted))


def depth_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, depth, n_titles, median_body, structural, titles)``, a row a depth."""
    return line_arrays(docs, key, text).select(key, F.inline(depth_table(headings(F.col("ls")))))


def structural_count(table: Column) -> Column:
    """Titles of the shallowest depth with two or more, else of all depths."""
    several = lambda t: F.get(F.filter(t, lambda d: d["titles"] >= 2), F.lit(0))["titles"]
    return T.let(table, lambda t: F.coalesce(several(t), F.aggregate(t, F.lit(0).cast("long"), lambda a, d: a + d["titles"])))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: Column, number: Number = H.stripped_chapter_number) -> DataFrame:
    """``(key, chapters_detected, chapters_method, chapter_headings_sample, has_toc)`` of every document, and the columns ``more``.

    Headings by depth are only sought in documents without numbered chapters.
    """
    rows = line_arrays(docs, key, text, F.coalesce(H.has_toc(F.col(text)), F.lit(False)).alias("has_toc"), *more)
    rows = rows.withColumn("heads", numbered(F.col("ls"), number)).withColumn("numeric", chapter_count(F.col("heads")))
    n = F.when(F.col("numeric") > 0, F.col("numeric")).otherwise(structural_count(depth_table(headings(F.col("ls")))))
    method = F.when(F.col("numeric") > 0, "numeric").when(F.col("n") > 0, "structural").otherwise("none")
    sample = F.transform(F.slice("heads", 1, SAMPLE), lambda x: x["s"])
    rows = rows.withColumn("n", n)
    return rows.select(key, F.col("n").alias("chapters_detected"), method.alias("chapters_method"), sample.alias("chapter_headings_sample"), *(c for c in rows.columns if c not in (key, "ls", "heads", "numeric", "n")))


def segment_array(ls: Column, number: Number = H.stripped_chapter_number) -> Column:
    """``array<struct<seg_id, number, heading, body>>``: segment 0 is what stands before the first chapter heading, even if empty."""

    def one(lines: Column, heads: Column, k: Column) -> Column:
        head = F.get(heads, k - 1)
        a, z = F.coalesce(head["line_no"], F.lit(0)), F.coalesce(F.get(heads, k)["line_no"], F.size(lines))
        return F.struct(k.cast("long").alias("seg_id"), head["number"].alias("number"), F.coalesce(head["s"], F.lit("__front__")).alias("heading"), F.array_join(F.slice(lines, a + 1, z - a), "\n").alias("body"))

    return T.let(ls, lambda lines: T.let(numbered(lines, number), lambda heads: F.transform(F.sequence(F.lit(0), F.size(heads)), lambda k: one(lines, heads, k))))


def _segmented(docs: DataFrame, key: str, text: str, *more: Column, number: Number = H.stripped_chapter_number) -> DataFrame:
    return line_arrays(docs, key, text, *more).withColumn("segs", segment_array(F.col("ls"), number)).drop("ls")


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", number: Number = H.stripped_chapter_number) -> DataFrame:
    """``(key, seg_id, number, heading, body)``, a row a segment."""
    return _segmented(docs, key, text, number=number).select(key, F.inline("segs"))


def best_chapters(segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each chapter number its segment with the most tokens, the first of equals: ``(key, number, heading, tokens)``."""
    rows = segs.where("number is not null").select(key, "number", "heading", "seg_id", T.word_tokens(F.col("body")).alias("tokens"))
    best = F.max_by(F.struct("heading", "tokens"), F.struct("tokens", -F.col("seg_id")))
    return rows.groupBy(key, "number").agg(best.alias("b")).select(key, "number", "b.heading", "b.tokens")


def skill_size(files: DataFrame, target: int, core: int = 4000, chapter: int = 1000) -> DataFrame:
    """``(core, chapter, measured)``, one row: tokens of a bundle's entry file and of its chapter ``target``.

    ``files(path, text)``.  Without the entry file ``core`` stands in; without the target's file the mean of
    all chapter files, and without any ``chapter``.
    """
    rows = files.select("path", T.word_tokens(F.col("text")).alias("n"))
    in_chapters = F.col("path").rlike(r"^chapters/[^/]*\.md$")
    own = in_chapters & F.col("path").rlike(rf"ch0*{target}(?![\p{{L}}\p{{N}}_])[^/]*$")
    entry = F.max(F.when(F.col("path") == "SKILL.md", F.col("n")))
    mean = F.floor(F.sum(F.when(in_chapters, F.col("n"))) / F.count(F.when(in_chapters, 1)))
    found = F.min_by(F.when(own, F.col("n")), F.when(own, F.col("path")))
    measured = F.coalesce(F.nullif(F.coalesce(found, mean), F.lit(0)), F.lit(chapter)).cast("long")
    return rows.agg(F.coalesce(entry, F.lit(core)).cast("long").alias("core"), measured.alias("chapter"), entry.isNotNull().alias("measured"))


def discovery_cost(docs: DataFrame, target: int = 5, core: int = 4000, chapter: int = 1000, key: str = "doc_id", text: str = "text", skill: DataFrame | None = None, number: Number = H.stripped_chapter_number) -> DataFrame:
    """Tokens that ways of answering one question cost: ``(key, target, dump, toc, best, loop, skill, vs_dump, vs_best, vs_loop)``.

    Documents without chapters have no row.  The target is a chapter's number, or where it is missing the
    chapter in that place, or the last.  ``skill``: the one row of ``skill_size`` to use in place of ``core`` and ``chapter``.
    """
    rows = _segmented(docs, key, text, T.word_tokens(F.col(text)).alias("dump"), number=number)
    # one number a segment from here on; the texts end in this step
    at = lambda body: H.toc_start(body)
    body = F.get("segs", F.lit(0))["body"]
    toc = T.word_tokens(F.when(at(body) > 0, body.substr(at(body), F.length(body))).otherwise(body))
    sizes = F.transform(F.filter("segs", lambda s: s["number"].isNotNull()), lambda s: F.struct(s["number"].alias("number"), T.word_tokens(s["body"], in_array=True).alias("tokens")))
    rows = rows.select(key, "dump", toc.alias("toc"), sizes.alias("sizes")).where(F.size("sizes") > 0)
    numbers = F.array_sort(F.array_distinct(F.transform("sizes", lambda s: s["number"])))
    rows = rows.withColumn("numbers", numbers)
    pick = F.when(F.array_contains("numbers", target), target).otherwise(F.element_at("numbers", F.least(F.lit(target), F.size("numbers"))))
    rows = rows.withColumn("target", pick)
    most = lambda n: F.array_max(F.transform(F.filter("sizes", lambda s: s["number"] == n), lambda s: s["tokens"]))
    own, prior = most(F.col("target")), F.coalesce(most(F.col("target") - 1), F.lit(0))
    size = F.lit(core + chapter).cast("long")
    if skill is not None:  # one row
        rows, size = rows.join(F.broadcast(skill.select((F.col("core") + F.col("chapter")).alias("_size"))), F.lit(True)), F.col("_size")
    rows = rows.select(key, "target", "dump", "toc", (F.col("toc") + own).alias("best"), (F.col("toc") + own + prior).alias("loop"), size.alias("skill"))
    r = lambda c: T.ratio(F.col(c), F.col("skill"))
    return rows.select("*", r("dump").alias("vs_dump"), r("best").alias("vs_best"), r("loop").alias("vs_loop"))
