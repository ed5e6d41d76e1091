"""Packing documents into fixed windows: deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_slices, with_columns_of
from .prefix import running_totals
from .tokens import tokenizer

#: Tokens of a sequence, which is one round of the queues; tokens of a queue that go together; tokens (about) of a slice.
WINDOW, LEAST, SLICE = 2048, 64, 1 << 18
#: Rows that may be broadcast, some 10 MB.
HANDED = 1 << 17
#: Bytes of text encoded at once: more words at once make fewer rounds of merges.
ENCODED = 4 << 20


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public tokenizer file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order: tuple[Column, ...] = ()
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, row)``: a row a piece.

    Every source is a queue with a target share of each window, its share of all tokens.  In every round a
    queue's deficit counter grows by its share of WINDOW tokens; it sends as many tokens as the counter
    holds, once these are LEAST or end the queue, and the counter goes down by what was sent.  What is left
    goes on to the next round, window and slice.  Slices cut every queue at the same part of its tokens, in
    whole LEAST, so the queues of a slice run out together and each window of it has all of them; a slice
    starts with the deficits that running totals of what was sent before leave, and where the slice
    before it ends, so only the last sequence of all has padding.

    A queue's documents stand in the order of the table, or in that of the columns ``order``, by which they
    are range-sorted first.  ``row`` numbers the rows of ``docs`` in that order and so tells repeats apart.

    * null text: empty; an empty document is its end token alone.
    * null source: a queue of its own.  Repeated rows and ids: every row is packed.
    * empty table: empty result.  Extra columns of ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"), *(c.alias(f"_o{k}") for k, c in enumerate(order)))
    if order:
        by = [F.col(f"_o{k}") for k in range(len(order))]
        plain = plain.repartitionByRange(*by).sortWithinPartitions(*by)
    ids = scratch.save(plain.select("doc_id", "text", "source").mapInArrow(_encode(tokenizer_path, end_id), "part long, row long, doc_id long, source string, within long, n long, ids binary"))
    sums = scratch.save(ids.groupBy("source", "part").agg(F.sum("n").alias("n")))
    size = sums.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    total = size["n"] or 0
    slices = max(1, -(-total // SLICE))
    every = sums.groupBy("source").agg((F.sum("n") / F.lit(float(max(1, total)))).alias("share")).withColumnRenamed("source", "of")
    told = running_totals(sums, "source", "part", "n", "before")
    told = told.join(every, F.col("source").eqNullSafe(F.col("of"))).select("of", F.col("part").alias("p"), "before", "share")
    # a row a source and part of the table: handed to the tasks while these are few, so that the ids are dealt out once
    told = F.broadcast(told) if size["rows"] <= HANDED else told
    placed = ids.join(told, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")))
    cut = _sliced(placed.select("row", "doc_id", "source", "share", (F.col("before") + F.col("within")).alias("b"), "n", "ids"), slices)
    base = running_totals(cut.groupBy("slot").agg(F.sum("length").alias("n")), F.lit(0), "slot", "n", "base").select(F.col("slot").alias("of_slot"), "base")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, row long"
    return cut.groupBy("slot").cogroup(base.groupBy("of_slot")).applyInArrow(_pack, kind)


def _sliced(placed: DataFrame, slices: int) -> DataFrame:
    """Rows of ``placed`` cut at the bounds of slices: ``b`` is where a document starts in its queue, ``at`` where its part does."""
    per = F.col("share") * SLICE / LEAST  # units of a queue to a slice
    b, e = F.col("b"), F.col("b") + F.col("n")
    first, last = F.floor(b / LEAST), F.floor((e - 1) / LEAST)
    # a queue with less than a unit to a slice is cut by units, others by slices; a slice too many at either side has no part
    wide = per >= 1
    lo, hi = F.greatest(F.lit(0), F.floor(first / per) - 1), F.least(F.lit(slices - 1), F.floor((last + 1) / per) + 1)
    unit = F.when(wide, F.sequence(F.least(lo, hi).cast("long"), hi.cast("long"))).otherwise(F.sequence(first, last))
    rows = placed.withColumn("unit", F.explode(unit))
    u = F.col("unit")
    slot = F.when(wide, u).otherwise(F.least(F.lit(slices - 1), F.ceil((u + 1) / per) - 1))
    start = F.when(wide, F.floor(u * per)).otherwise(u) * LEAST
    end = F.when(wide & (u == slices - 1), e).otherwise(F.when(wide, F.floor((u + 1) * per)).otherwise(u + 1) * LEAST)
    at, to = F.greatest(b, start), F.least(e, end)
    rows = rows.withColumn("slot", slot.cast("long")).withColumn("at", at).withColumn("length", to - at).where("length > 0")
    size = F.expr("length(ids) div n")
    part = F.substring("ids", ((F.col("at") - b) * size + 1).cast("int"), (F.col("length") * size).cast("int"))
    return rows.select("slot", "row", "doc_id", "source", "share", "at", (F.col("at") - b).alias("start"), "length", F.col("n").alias("doc_tokens"), part.alias("ids"))


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = np.array([end_id], tok.kind).tobytes()
        task = TaskContext.get().partitionId()
        row, sent = task << 40, {}
        for batch in batches:
            for part in row_slices(batch, "text", ENCODED):
                ids = [x + end for x in tok.ids(part.column("text").to_pylist())]
                n = [len(x) // tok.kind.itemsize for x in ids]
                within = []
                for s, k in zip(part.column("source").to_pylist(), n, strict=True):
                    within.append(sent.get(s, 0))
                    sent[s] = within[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), task)), pa.array(np.arange(row, row + len(n))), part.column("doc_id"), part.column("source"), pa.array(within, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "row", "doc_id", "source", "within", "n", "ids"],
                )
                row += len(n)

    return run


def rounds(share: list[float], first: list[int], last: list[int], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(queue, from, count)`` in the order sent, for queues that hold their tokens ``[first, last)`` and a slice from token ``base``."""
    deficit = [s * base - a for s, a in zip(share, first, strict=True)]
    at, out = list(first), []
    live = list(range(len(share)))
    turns = -(-(sum(last) - sum(first)) // WINDOW)
    while live:
        turns -= 1
        for q in live:
            deficit[q] += share[q] * WINDOW
            left = last[q] - at[q]
            send = min(left, int(deficit[q])) if turns >= 0 else left  # after the last round, what fractions of units hold back
            if send >= LEAST or send == left:
                out.append((q, at[q], send))
                at[q] += send
                deficit[q] -= send
        live = [q for q in live if at[q] < last[q]]
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _pack(docs: pa.Table, told: pa.Table) -> pa.Table:
    """One slice: its queues in code-point order, null last; a queue's documents in their order."""
    tokenizer.cache_clear()  # the words that a worker has remembered are of no more use
    source = docs.column("source").to_pylist()
    names = sorted(set(source), key=lambda s: (s is None, s or ""))
    rank = {s: k for k, s in enumerate(names)}
    queue = np.array([rank[s] for s in source], np.int64)
    at, length = docs.column("at").to_numpy(), docs.column("length").to_numpy()
    order = np.lexsort((at, queue))
    queue, at, length = queue[order], at[order], length[order]
    head = np.flatnonzero(np.append(True, queue[1:] != queue[:-1]))
    tail = np.append(head[1:], len(queue)) - 1
    share = docs.column("share").to_numpy()[order][head]
    base = told.column("base")[0].as_py()
    who, since, count = rounds(share.tolist(), at[head].tolist(), (at[tail] + length[tail]).tolist(), base)
    # a piece starts where a turn, a document or a window does
    out = np.cumsum(count) - count
    total = int(count.sum())
    far = 1 << 44  # queues side by side on one line; a queue's place in a slice counts from its first token
    line = who * far + since - at[head][who]
    by = np.argsort(line, kind="stable")
    doc = queue * far + at - at[head][queue]
    turn = by[np.searchsorted(line[by], doc, side="right") - 1]
    edges = np.unique(np.concatenate([out, out[turn] + doc - line[turn], np.arange(-base % WINDOW, total, WINDOW)]))
    turn = np.searchsorted(out, edges, side="right") - 1
    place = line[turn] + edges - out[turn]
    of = np.searchsorted(doc, place, side="right") - 1
    window = (base + edges) // WINDOW
    goes_on = np.zeros(len(edges), bool)
    goes_on[1:] = (of[1:] == of[:-1]) & (place[1:] - place[:-1] == np.diff(edges)) & (window[1:] == window[:-1])
    edges, place, of, window = edges[~goes_on], place[~goes_on], of[~goes_on], window[~goes_on]
    size = np.diff(np.append(edges, total))
    skip = place - doc[of]
    raw = [docs.column("ids")[int(k)].as_py() for k in order]
    width = len(raw[0]) // int(length[0])
    wide = np.frombuffer(b"".join(raw), f"<u{width}").astype("<u4")
    a = (np.cumsum(length) - length)[of] + skip
    view = memoryview(wide).cast("B")
    crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + size).tolist(), strict=True)]
    row = order[of]
    get = lambda c: docs.column(c).take(pa.array(row))
    start = docs.column("start").to_numpy()[row] + skip
    cols = [get("doc_id"), start, size, pa.array(crc, pa.int64()), get("doc_tokens"), window, (base + edges) % WINDOW, get("source"), get("row")]
    return pa.table(dict(zip(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "row"], cols, strict=True)))
