"""Running headers, footers and page numbers of page-broken text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T

LEAST_PAGES = 3
#: A page number: up to four digits, or a canonical Roman numeral of 1 to 99, alone on its line.
PAGE_NUMBER = rf"(?iuU)^(?:\d{{1,4}}|{'|'.join(H.roman(n) for n in range(1, 100))})$"


def _edges(page: Column) -> Column:
    """Places (from 0) of the first and the last line that is not blank, once if they are the same."""
    full = F.filter(F.transform(page, lambda x, i: F.when(~T.is_blank(x), i)), lambda i: i.isNotNull())
    return F.array_distinct(F.filter(F.array(F.get(full, F.lit(0)), F.get(full, F.size(full) - 1)), lambda i: i.isNotNull()))


def _running(pages: Column) -> Column:
    """Edge lines that stand at the edges of more than half of the pages."""
    edges = F.array_sort(F.flatten(F.transform(pages, lambda p: F.transform(p["at"], lambda i: T.strip(F.get(p["ls"], i))))))
    # of sorted votes, a line with more than half of the pages stands at one of every ``half`` places at least
    half = F.greatest(F.lit(1), F.floor(F.size(pages) / 2).cast("int"))
    some = lambda votes: F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), F.size(pages) * 2, half), lambda k: F.get(votes, k)), lambda x: x.isNotNull()))
    return T.let(edges, lambda votes: F.filter(some(votes), lambda x: F.size(F.filter(votes, lambda v: v == x)) > F.size(pages) / 2))


def _cleaned(pages: Column) -> Column:
    """The text of an array of struct ``(ls, at)``, a page's lines and its edges, without edges that run through or number pages."""
    gone = lambda running, x: F.array_contains(running, T.strip(x)) | T.strip(x).rlike(PAGE_NUMBER)
    kept = lambda running: F.transform(pages, lambda p: F.filter(p["ls"], lambda x, i: ~(F.array_contains(p["at"], i) & gone(running, x))))
    return T.let(_running(pages), lambda running: F.array_join(F.flatten(kept(running)), "\n"))


def clean_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)``: page edges that run through the document or number pages are dropped, then hyphens rejoined.

    An edge runs through with more than half of all pages of a document with LEAST_PAGES or more; documents with
    fewer pages only have their page breaks turned into line breaks.  All of it stays in the document's row.
    """
    return docs.select(key, cleaned(F.col(text)).alias("text"))


def cleaned(text: Column) -> Column:
    pages = lambda page: F.transform(page, lambda ls: F.struct(ls.alias("ls"), _edges(ls).alias("at")))
    page = F.transform(F.split(text, "\f", -1), lambda x: T.lines(x))
    short = F.translate(text, "\f", "\n")
    return T.rejoin_hyphens(T.let(page, lambda p: F.when(F.size(p) >= LEAST_PAGES, T.let(pages(p), _cleaned)).otherwise(short)))
