"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices, with_columns_of
from .minhash_core import mix

#: Documents (about) on which costs and rejections are estimated.
SAMPLE = 512
#: Words to a block in which different words are counted.
BLOCK = 2000
_SPACE, _SYMBOL = b"\t\n\v\f\r ", b"#*$%&|<>"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
#: Finds each word with a letter once: from its first letter to its end.
_LETTERED = re.compile(rb"[A-Za-z\x80-\xff][^\t-\r ]*")

Counts = dict[str, int]
Rule = Callable[[bytes, Counts], bool]


def base_counts(text: str | None) -> Counts:
    """The counts that every document gets, whatever the cascade decides."""
    raw = text.encode() if text else b""
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    lines = [x for x in text.split("\n") if x.strip("\t\n\v\f\r ")] if text else []
    return {
        "n_words": len(words),
        "word_chars": (len(text) if text else 0) - spaces,
        "n_symbols": len(raw) - len(raw.translate(None, _SYMBOL)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
    }


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of three found twice or more among ``words``, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    g = mix(mix(h[:n]) + h[1 : n + 1]) + h[2 : n + 2] * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : n + k] |= again
    return int(covered.sum())


def base_failed(c: Counts) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def _symbols(raw: bytes, c: Counts) -> bool:
    return 10 * c["n_symbols"] > c["word_chars"]


def _dup_lines(raw: bytes, c: Counts) -> bool:
    return 2 * c["n_dup_lines"] > c["n_lines"] and c["n_dup_lines"] >= 3


def _word_length(raw: bytes, c: Counts) -> bool:
    return not 2 * c["n_words"] <= c["word_chars"] <= 25 * c["n_words"]


def _capitals(raw: bytes, c: Counts) -> bool:
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    return 10 * (len(raw) - len(raw.translate(None, _UPPER))) > 6 * letters and letters > 0


def _exclaiming(raw: bytes, c: Counts) -> bool:
    return 10 * (raw.count(b"!") + raw.count(b"?")) > 3 * c["n_words"]


def _no_letters(raw: bytes, c: Counts) -> bool:
    """More than a fifth of the words hold no letter; a character outside ASCII counts as one."""
    return 5 * (c["n_words"] - len(_LETTERED.findall(raw))) > c["n_words"]


def _few_words(raw: bytes, c: Counts) -> bool:
    """Blocks of equal size, BLOCK words or up to twice that, in which fewer than one word of twenty is new to its block.

    The block keeps the rule alike at every length: the share of new words in a whole text falls with its length.
    """
    words = raw.lower().split()
    n = len(words)
    blocks = max(1, n // BLOCK)
    cuts = [-(-k * n // blocks) for k in range(blocks + 1)]
    return n >= 50 and 20 * sum(len(set(words[a:z])) for a, z in zip(cuts, cuts[1:], strict=False)) < n


#: A rule rejects a document where it holds.  The verdict doesn't depend on the order.
RULES: dict[str, Rule] = {"symbols": _symbols, "dup_lines": _dup_lines, "word_length": _word_length, "capitals": _capitals, "exclaiming": _exclaiming, "no_letters": _no_letters, "few_words": _few_words}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` for every row.

    The base counts cover whole texts.  A document that passes the base goes through RULES until one
    rejects it; the order is that of rejections per second on a sample drawn by a hash, so it may differ
    from run to run, and the verdict never does.

    * null or word-less text: all counts 0, base_failed, not kept.  Null ids and repeated rows: as any row.
    * empty table: empty result.  Extra columns of ``docs`` are ignored.
    """
    plain = with_columns_of(docs, id_col, text_col).toDF("doc_id", "text")
    return plain.mapInArrow(
        _apply(cascade(plain)),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean",
    )


def cascade(plain: DataFrame) -> list[str]:
    """The rules' names, the most rejections per second first; ties and empty samples by name."""
    total = plain.count()
    some = plain.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, total // SAMPLE))) == 0)
    cost = some.mapInArrow(_measure, "rule string, ns long, rejected long").groupBy("rule").agg(F.sum("ns").alias("ns"), F.sum("rejected").alias("n"))
    rate = {r["rule"]: r["n"] / max(1, r["ns"]) for r in cost.collect()}
    return sorted(RULES, key=lambda name: (-rate.get(name, 0), name))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ns, rejected = dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            c, raw = base_counts(text), (text or "").encode()
            for name, rule in RULES.items():
                t = time.perf_counter_ns()
                rejected[name] += rule(raw, c)
                ns[name] += time.perf_counter_ns() - t
    yield pa.RecordBatch.from_arrays([pa.array(list(RULES)), pa.array(list(ns.values()), pa.int64()), pa.array(list(rejected.values()), pa.int64())], ["rule", "ns", "rejected"])


def _apply(order: list[str]):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [RULES[n] for n in order]
        for batch in batches:
            for part in row_slices(batch, "text"):
                counts, failed, kept = [], [], []
                for text in part.column("text").to_pylist():
                    c = base_counts(text)
                    counts.append(c)
                    failed.append(base_failed(c))
                    raw = text.encode() if text and not failed[-1] else b""
                    kept.append(not failed[-1] and not any(rule(raw, c) for rule in rules))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([c[n] for c in counts], pa.int64()) for n in names), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                    ["doc_id", *names, "base_failed", "kept"],
                )

    return run
