"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import row_slices, with_columns_of
from .html_blocks import Block, Labeller, blocks, inputs, padded
from .html_training import trained

#: Pages, and blocks of them, that the network reads at once; a longer page is read alone.
PAGES, BLOCKS = 128, 1 << 13


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    A page is a sequence of leaf blocks.  A bidirectional LSTM, trained on invented pages with the same
    result each time, reads every block's hashed tag path and words in the context of the whole page and
    labels it main text or not; the main blocks are joined in page order by a line feed.

    * null or empty html, or no main block: empty text.  Null ids and urls, repeated rows: as any row.
    * empty table: empty result.  Extra columns of ``pages`` are ignored.
    """
    plain = with_columns_of(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    return plain.mapInArrow(_extract(_model()), "page_id long, url string, text string, n_chars long")


@lru_cache(maxsize=1)
def _model() -> Labeller:
    return trained()


def label(pages: list[list[Block]], net: Labeller) -> list[np.ndarray]:
    """Of every page, which of its blocks are main text."""
    found = [np.zeros(len(p), bool) for p in pages]
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < PAGES and (to - at + 1) * len(pages[order[to]]) <= BLOCKS:
            to += 1
        some = order[at:to]
        odds = net.odds(*padded([inputs(pages[k]) for k in some]))
        for r, k in enumerate(some):
            found[k] = odds[r, : len(pages[k])] > 0
        at = to
    return found


def _extract(net: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "html"):
                pages = [blocks(h) for h in part.column("html").to_pylist()]
                text = ["\n".join(b.text for b, ok in zip(p, main, strict=True) if ok) for p, main in zip(pages, label(pages, net), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run
