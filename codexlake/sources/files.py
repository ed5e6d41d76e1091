"""Files of many formats to records with text: listing, reading, and what each reader needs."""

from __future__ import annotations

import importlib.util
import io
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import markup
from ..functions import text as T
from ..operators import corpus, structure
from ..operators import pages as page_ops
from ..operators.ranking import ranked, stored
from . import containers
from .encoding import decode_text

# What each suffix holds.
TEXTS = (".txt", ".text", ".md", ".markdown", ".rst", ".adoc", ".asciidoc")
PAGES = (".html", ".htm", ".xhtml")
CALIBRE = (".mobi", ".azw", ".azw3")
SUFFIXES = (".pdf", ".epub", ".docx", ".rtf", *TEXTS, *PAGES, *CALIBRE)
#: What each format's readers need beyond the standard library.
NEEDS = {
    "pdf": ("docling", "pdftotext", "pypdf", "pdfminer"), "mobi": ("ebook-convert",), "epub": ("ebooklib", "bs4"), "docx": ("docx",), "rtf": ("striprtf",), "html": ("trafilatura", "bs4"), "text": (),
}
_PROGRAMS = ("pdftotext", "ebook-convert")

RECORD = "format string, text string, method string, pages long, pages_label string, images_dropped long, error string"


# --- readers: each takes a file's bytes and its decoded text, and gives a text or nothing


@dataclass(frozen=True)
class Reader:
    """A way of reading a format; ``needs`` names a module or program that must be there."""

    method: str
    read: Callable[[bytes | None, str | None], str | None]
    needs: str = ""

    def present(self) -> bool:
        return not self.needs or here(self.needs)


def here(tool: str) -> bool:
    return shutil.which(tool) is not None if tool in _PROGRAMS else importlib.util.find_spec(tool) is not None


def _run(tool: str, content: bytes, suffix: str, seconds: int, *more: str) -> str | None:
    """A program that reads one file and writes another; both lie in a folder of the task that is gone afterwards."""
    with tempfile.TemporaryDirectory() as folder:
        source, target = os.path.join(folder, f"in{suffix}"), os.path.join(folder, "out.txt")
        with open(source, "wb") as f:
            f.write(content)
        done = subprocess.run([tool, *more, source, target], capture_output=True, timeout=seconds, check=False)
        if done.returncode or not os.path.exists(target):
            return None
        with open(target, encoding="utf-8", errors="replace") as f:
            return f.read()


def _pypdf_pages(content: bytes, most: int | None = None) -> list[str]:
    import pypdf

    out = []
    for page in pypdf.PdfReader(io.BytesIO(content)).pages[:most]:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # a page that fails is an empty page
            out.append("")
    return out


def _pdfminer(content: bytes, _: str | None) -> str:
    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(content))


def _docling(content: bytes, _: str | None) -> str:
    from docling.datamodel.base_models import DocumentStream
    from docling.document_converter import DocumentConverter

    return DocumentConverter().convert(DocumentStream(name="in.pdf", stream=io.BytesIO(content))).document.export_to_markdown()


def _ebooklib(content: bytes, _: str | None) -> str:
    import bs4
    from ebooklib import ITEM_DOCUMENT, epub

    with tempfile.NamedTemporaryFile(suffix=".epub") as f:
        f.write(content)
        f.flush()
        book = epub.read_epub(f.name)
    return "\n\n".join(bs4.BeautifulSoup(x.get_content(), "html.parser").get_text("\n") for x in book.get_items_of_type(ITEM_DOCUMENT))


def _python_docx(content: bytes, _: str | None) -> str:
    """Paragraphs, then the tables' rows, cells joined by tabs."""
    import docx

    document = docx.Document(io.BytesIO(content))
    rows = ["\t".join(c.text.strip() for c in row.cells) for table in document.tables for row in table.rows]
    return "\n".join([p.text for p in document.paragraphs] + [r for r in rows if r.strip()])


def _trafilatura(_: bytes | None, decoded: str | None) -> str | None:
    import trafilatura

    return trafilatura.extract(decoded or "")


def _bs4(_: bytes | None, decoded: str | None) -> str:
    import bs4

    page = bs4.BeautifulSoup(decoded or "", "html.parser")
    for part in page(["script", "style", "head"]):
        part.decompose()
    return page.get_text("\n")


def pictures_only(content: bytes) -> bool:
    """Whether the first pages of a PDF hold no text; no, where nothing is there that could tell."""
    try:
        if here("pdftotext"):
            text = _run("pdftotext", content, ".pdf", 120, "-l", "5")
            return text is not None and not text.strip()
        return here("pypdf") and not any(p.strip() for p in _pypdf_pages(content, 5))
    except Exception:
        return False


def _striprtf(_: bytes | None, decoded: str | None) -> str:
    from striprtf.striprtf import rtf_to_text

    return rtf_to_text(decoded or "")


#: Of each format its readers in the order they are tried: the first that is there and gives a text that isn't blank is the one whose method is told.
READERS: dict[str, tuple[Reader, ...]] = {
    "epub": (Reader("ebooklib", _ebooklib, "ebooklib"), Reader("zipfile", lambda b, _: containers.read_epub(b)["text"])),
    "docx": (Reader("python-docx", _python_docx, "docx"), Reader("zipfile", lambda b, _: containers.read_docx(b))),
    "rtf": (Reader("striprtf", _striprtf, "striprtf"), Reader("rtf-fallback", lambda _, t: markup.rtf_text(t or ""))),
    "html": (Reader("html-parser", lambda _, t: markup.html_text(t or "")),),
    "pdf": (
        Reader("pdftotext", lambda b, _: _run("pdftotext", b, ".pdf", 120, "-layout"), "pdftotext"), Reader("pypdf", lambda b, _: "\f".join(_pypdf_pages(b)), "pypdf"), Reader("pdfminer", _pdfminer, "pdfminer"),
    ),
    "mobi": (Reader("ebook-convert", lambda b, _: _run("ebook-convert", b, ".mobi", 300), "ebook-convert"),),
}


@dataclass(frozen=True)
class Options:
    """How files are read.

    ``mode`` is ``text`` or ``technical``: the latter tries the layout-aware PDF reader first; anything else
    is ``text``.  ``main_text``: pages are first tried by readers that leave menus and such out.
    """

    mode: str = "text"
    main_text: bool = False
    readers: dict[str, tuple[Reader, ...]] = field(default_factory=lambda: dict(READERS))

    def of(self, kind: str) -> tuple[Reader, ...]:
        first: tuple[Reader, ...] = ()
        if self.mode == "technical" and kind == "pdf":
            first = (Reader("docling", _docling, "docling"),)
        if self.main_text and kind == "html":
            first = (Reader("trafilatura", _trafilatura, "trafilatura"), Reader("bs4", _bs4, "bs4"))
        return first + self.readers.get(kind, ())


# --- listing


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def resolve(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """``(kind, path)`` of each request, ``~`` expanded: a file, a folder, a pattern, or missing; in any store that Spark reads.

    Only the requests themselves are looked at; what is in folders and behind patterns Spark lists.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for given in paths:
        p = os.path.expanduser(given)
        p = p if re.match(r"[a-zA-Z][\w+.-]*:", p) else os.path.abspath(p)
        where = jvm.org.apache.hadoop.fs.Path(p)
        store = where.getFileSystem(conf)
        if store.exists(where):
            kind = "folder" if store.getFileStatus(where).isDirectory() else "file"
        elif any(c in p for c in "*?["):
            kind = "pattern" if "**" in p or len(store.globStatus(where) or []) else "missing"
        else:
            kind = "missing"
        out.append((kind, p))
    return out


def _listed(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The files of one request, their content unread until it is asked for."""
    reader = spark.read.format("binaryFile")
    if kind == "pattern" and "**" in path:  # any depth: the folder before, the name after
        path, _, name = path.partition("**")
        rows = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name.rpartition("/")[2] or "*").load(path)
    else:
        rows = (reader.option("recursiveFileLookup", "true") if kind == "folder" else reader).load(path)
    rows = rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", "length")
    return rows if kind == "file" else rows.where(suffix_of(F.col("path")).isin(*SUFFIXES))


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source_ord, path, filename, content, length)``: each file once, in the order it is first asked for; content null if missing.

    The files of a folder or pattern come by lower-cased path.
    """
    asked = resolve(spark, paths)
    missing = spark.createDataFrame([(k, p) for k, (kind, p) in enumerate(asked) if kind == "missing"], "request int, path string")
    there = [_listed(spark, kind, p).withColumn("request", F.lit(k)) for k, (kind, p) in enumerate(asked) if kind != "missing"]
    names = reduce(DataFrame.unionByName, (r.select("request", "path") for r in there), missing)
    first = names.groupBy("path").agg(F.min("request").alias("request"))
    order = ranked(first.withColumn("lower", F.lower("path")), ["request", "lower", "path"], "n").select((F.col("n") - 1).cast("int").alias("source_ord"), "path", "request")
    if there:
        read = reduce(DataFrame.unionByName, there).withColumnRenamed("path", "p").withColumnRenamed("request", "r")
        rows = order.join(read, (F.col("path") == F.col("p")) & (F.col("request") == F.col("r")), "left")
    else:
        rows = order.select("*", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("long").alias("length"))
    return rows.dropDuplicates(["source_ord"]).select("source_ord", "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All supported files under a folder of any store that Spark reads, numbered from 0 by lower-cased path."""
    rows = _listed(spark, "folder", folder)
    return numbered(rows, rows)


def numbered(names: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(path, content, length)`` with their place in the order of lower-cased paths; only ``path`` of ``names`` is sorted."""
    order = ranked(names.select("path", F.lower("path").alias("lower")), ["lower", "path"], "n").select(F.col("path").alias("p"), (F.col("n") - 1).alias("source_ord"))
    return rows.join(order, F.col("path") == F.col("p")).select("source_ord", "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length")


# --- reading


def read_one(kind: str | None, content: bytes | None, decoded: str | None, options: Options) -> dict:
    """One file's record; a failure stays in it, and so do the failures of readers before the one that gave text."""
    row: dict = {"text": None, "method": None, "pages": 0, "pages_label": "sections", "images_dropped": None, "error": None}
    failed = []
    try:
        if kind == "pdf" and pictures_only(content):
            return row | {"error": "the first pages hold pictures only"}
        readers = options.of(kind or "")
        for reader in readers:
            if not reader.present():
                failed.append(f"{reader.method}: {reader.needs} is not there")
                continue
            try:
                text = reader.read(content, decoded)
            except Exception as e:
                failed.append(f"{reader.method}: {type(e).__name__}: {e}")
                continue
            if text and text.strip():
                row |= {"text": text, "method": reader.method}
                break
            failed.append(f"{reader.method}: no text could be extracted")
        if row["text"] is None:
            row["error"] = "; ".join(failed) if readers else f"no reader for {kind or 'this format'}"
        elif kind == "epub":
            told = containers.read_epub(content)
            row |= {"pages": told["spine_items"], "pages_label": "spine_items", "images_dropped": told["images"]}
        elif kind == "pdf":
            row |= {"pages": _pdf_pages(content, row["text"]), "pages_label": "pages"}
    except Exception as e:  # one bad file must not end the batch
        row |= {"text": None, "error": f"{type(e).__name__}: {e}"}
    return row


def _pdf_pages(content: bytes, text: str) -> int:
    """Pages by the reader that knows them, else by breaks in the text, else 0."""
    try:
        if here("pypdf"):
            import pypdf

            return len(pypdf.PdfReader(io.BytesIO(content)).pages)
    except Exception:
        return 0
    return text.count("\f") + 1 if "\f" in text else 0


def extract(files: DataFrame, options: Options | None = None) -> DataFrame:
    """``files(source_ord, path, filename, content, length)`` to one record a file: text or error, method, pages, metrics.

    The suffix decides on the format, and the content where the suffix is unknown.  Each file is read once
    and parsed once: plain texts are decoded in the JVM, and only the others' bytes reach Python.  Texts are
    cleaned of invisible characters; PDF pages of running edges.
    """
    options = options or Options()
    s = suffix_of(F.col("path"))
    kind = F.when(s.isin(*TEXTS), "text").when(s.isin(*PAGES), "html").when(s.isin(*CALIBRE), "mobi").when(s.isin(".pdf", ".epub", ".docx", ".rtf"), F.substring(s, 2, 9))

    @F.pandas_udf(RECORD)
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for kinds, contents, decoded in batches:
            rows = []
            for k, c, t in zip(kinds, contents, decoded, strict=True):
                if c is None and t is None:
                    rows.append(dict.fromkeys(columns))
                    continue
                c = bytes(c) if c is not None else None
                k = k or containers.sniff(c)
                rows.append({"format": k} | read_one(k, c, t, options))
            yield pd.DataFrame(rows, columns=columns).astype({"pages": "Int64", "images_dropped": "Int64"})

    rows = files.withColumn("kind", kind).withColumn("decoded", F.when(F.col("kind").isin("text", "html", "rtf"), decode_text(F.col("content"))))
    plain = F.col("kind") == "text"
    to_parse = F.when(F.col("kind").isNull() | ~F.col("kind").isin("text", "html", "rtf"), F.col("content"))
    rows = rows.withColumn("r", parsed(F.col("kind"), to_parse, F.when(F.col("kind").isin("html", "rtf"), F.col("decoded"))))
    gone = F.col("content").isNull()
    text = F.when(plain, F.col("decoded")).otherwise(F.col("r.text"))
    text = F.when(F.col("kind") == "pdf", page_ops.cleaned(text)).otherwise(text)
    rows = rows.select(
        "source_ord", "path", "filename", "length", F.coalesce("kind", "r.format").alias("format"), text.alias("raw"), F.when(plain, "plain-text").otherwise(F.col("r.method")).alias("method"),
        F.coalesce("r.pages", F.lit(0)).cast("long").alias("pages"), F.coalesce("r.pages_label", F.lit("sections")).alias("pages_label"), F.col("r.images_dropped").alias("images_dropped"),
        F.when(gone, "file not found").otherwise(F.col("r.error")).alias("error"),
    )
    rows = rows.withColumn("removed", T.invisible_count(F.col("raw"))).withColumn("text", T.sanitize(F.col("raw"))).drop("raw")
    blank = F.col("text").isNull() | T.is_blank(F.col("text"))
    rows = rows.withColumn("error", F.coalesce("error", F.when(blank, "no text could be extracted"))).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
    t = F.col("text")
    return rows.select(
        "source_ord", "path", "filename", "length", "format", "text", F.when(t.isNotNull(), F.col("method")).alias("method"), "pages", "pages_label", "images_dropped", "error", "removed",
        T.size_mb(F.col("length")).alias("size_mb"), F.length(t).alias("chars"), T.word_count(t).alias("words"), T.estimate_tokens(t).alias("estimated_tokens"), H.has_toc(t).alias("has_toc"),
        (F.col("images_dropped") > containers.MANY_IMAGES).alias("many_images"),
    )


def records(files: DataFrame, options: Options | None = None) -> DataFrame:
    """The whole record of each file: ``extract`` with the structure of its text."""
    got = extract(files, options)
    found = structure.detect(got, "source_ord", "text", *(F.col(c) for c in got.columns if c not in ("source_ord", "has_toc")))
    return found.select(*got.columns, "chapters_detected", "chapters_method", "chapter_headings_sample")


def extract_batch(files: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """``(usable, failures)`` of a batch.  Files that fail are passed over; only if all of them do, so does the batch."""
    got = stored(extract(files, options))
    good, bad = got.where("error is null"), got.where("error is not null").select("source_ord", "path", F.col("error").alias("message"))
    if good.isEmpty() and not bad.isEmpty():
        some = "; ".join(f"{r['path']}: {r['message']}" for r in bad.orderBy("source_ord").limit(corpus.REPORTED).collect())
        raise ValueError(f"all {bad.count()} sources failed: {some}")
    return good, bad


def capabilities(spark: SparkSession) -> DataFrame:
    """``(format, tool, present)``: what each format's readers need, and whether it is here.  Nothing is installed."""
    rows = [(f, t, here(t)) for f, tools in NEEDS.items() for t in tools] + [(f, "standard library", True) for f, tools in NEEDS.items() if not tools]
    return spark.createDataFrame(rows, "format string, tool string, present boolean")
