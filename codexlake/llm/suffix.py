"""Exact repeated-substring removal: suffix arrays of shards of a corpus, merged by binary search.

1. Every whole text gives one row for each run of start positions that share a content-chosen anchor
   (``suffix_core.anchors``).  Equal LENGTH-byte strings always have equal anchor bytes, so a run whose
   anchor bytes occur once in the corpus has no repeated start.  All other runs are candidates, copies
   included.
2. Texts with candidates are range-sorted by their least candidate key, so copies lie side by side, and cut
   into shards of about SHARD_BYTES in that order; thousands of copies of one text just fill several
   shards.  A shard sorts the suffixes of its candidate bytes (Larsson-Sadakane), takes common prefixes
   (Kasai) and so knows the starts that occur again in it.
3. A run whose anchor occurs in no other shard is settled.  Of all others, each shard sends the fingerprint
   of every different start once, sorted and cut at common bounds by binary search; a range merges these
   sorted lists by binary search and sends back which starts another shard has too.
4. A document's removed bytes are the union of LENGTH bytes from each repeated start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix_core as core
from .common import BATCH_BYTES, Scratch, row_slices, with_columns_of

#: Bytes to a suffix array, fingerprints that a task keeps before it sends them, and (at most) of a range.
SHARD_BYTES, HELD, RANGE = 1 << 20, 1 << 20, 3 << 19

_RUN = "key long, rid long, first long, starts int"
_PIECE = "low long, rid long, first long, data binary, keys binary, offsets binary, often binary"
_FOUND = "place long, part long, rid long, a long, z long, prints binary, tags binary, offsets binary"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs``.

    A byte goes when a string of 200 bytes that covers it starts anywhere else in ``docs``, the same
    document included; matches lie within one text.  ``with_text`` adds ``kept_text``, the remaining
    bytes; where a cut splits a character, its remaining bytes are left out of ``kept_text`` alone.
    ``carry`` names string columns to pass on.

    * null or empty text: 0 bytes, 0 removed, the hash of the empty string.
    * null ids and repeated ids: rows are told apart by id and text; equal rows repeat each other.
    * empty table: empty result.  Extra columns of ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    plain = with_columns_of(docs, id_col, text_col, *carry).toDF("doc_id", "text", *carry).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(plain, scratch)
    joined = plain.join(spans, "rid", "left")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kind += ", kept_text string" * with_text + "".join(f", {c} string" for c in carry)
    return joined.select("doc_id", "text", "spans", *carry).mapInArrow(_cut(with_text, carry), kind)


def repeated_spans(plain: DataFrame, scratch: Scratch) -> DataFrame:
    """``(rid, spans)`` of the rows of ``plain(rid, text)`` with repeated strings; spans: [first byte, end)."""
    found = shards(pieces(plain, scratch), scratch)
    local = found.where("a is not null").select("rid", "a", "z")
    every = local.union(merged(found, scratch))
    every = every.select("rid", F.struct("a", (F.col("z") + core.LENGTH).alias("z")).alias("s"))
    return every.groupBy("rid").agg(F.collect_set("s").alias("spans"))


def pieces(plain: DataFrame, scratch: Scratch) -> DataFrame:
    """Stretches of candidate bytes with their runs: keys, first starts (in the stretch) and counts of the keys."""
    runs = scratch.save(plain.select("rid", "text").mapInArrow(_runs, _RUN))
    # written first, so that both sides of the join are read by their own exchange and a hot key's partition can be split
    often = scratch.save(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    meet = runs.join(often, "key").groupBy("rid").agg(F.collect_list(F.struct("first", "starts", "key", "n")).alias("of"))
    return scratch.save(plain.join(meet, "rid").select("rid", "text", "of").mapInArrow(_fetch(SHARD_BYTES // 2), _PIECE))


def shards(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """What each shard's suffix array tells: repeated starts ``(rid, a, z)``, fingerprints by range, and where places lie."""
    amount = cut.agg(F.sum(F.length("data")).alias("n")).first()["n"] or 0
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // RANGE))
    return scratch.save(cut.repartitionByRange("low", "rid", "first").sortWithinPartitions("low", "rid", "first").mapInArrow(_shards(parts, SHARD_BYTES, HELD), _FOUND))


def merged(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Starts that more than one shard has: ``(rid, a, z)``."""
    sent = found.where("prints is not null").select("place", "part", "prints", "tags", "offsets")
    back = sent.groupBy("part").applyInArrow(_search, "place long, offsets binary")
    told = found.where("prints is null and a is null").select("place", "tags", "offsets")
    return told.groupBy("place").cogroup(back.groupBy("place")).applyInArrow(_settle, "rid long, a long, z long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reach = core.LENGTH - 1
    for batch in batches:
        for part in row_slices(batch, "text"):
            rids = part.column("rid").to_pylist()
            texts = [b"" if x is None else x.encode() for x in part.column("text").to_pylist()]
            # a longer text goes in chunks that share the bytes a start at a chunk's end needs
            cut = [(r, c, t[c : c + BATCH_BYTES + reach]) for r, t in zip(rids, texts, strict=True) for c in range(0, max(1, len(t) - reach), BATCH_BYTES)]
            for some in _groups(cut):
                size = np.array([len(t) for _, _, t in some], np.int64)
                end = np.cumsum(size)
                first, last, key = core.anchors(np.frombuffer(b"".join(t for _, _, t in some), np.uint8), np.repeat(end, size))
                if len(first):
                    owner = np.searchsorted(end, first, side="right")
                    rid, base = (np.array([x[k] for x in some], np.int64)[owner] for k in (0, 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(rid), pa.array(first - (end - size)[owner] + base), pa.array((last - first + 1).astype(np.int32))],
                        ["key", "rid", "first", "starts"],
                    )


def _groups(cut: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Consecutive pieces of about BATCH_BYTES together."""
    some, size = [], 0
    for x in cut:
        if some and size + len(x[2]) > BATCH_BYTES:
            yield some
            some, size = [], 0
        some.append(x)
        size += len(x[2])
    if some:
        yield some


def _fetch(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("low", "rid", "first")] + [(n, pa.binary()) for n in ("data", "keys", "offsets", "often")])
        for batch in batches:
            for part in row_slices(batch, "text"):
                of = part.column("of")
                inner = of.flatten()
                first, starts, key, often = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("first", "starts", "key", "n"))
                bounds = np.concatenate([[0], np.cumsum(of.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                rows: list[tuple] = []
                for k, (rid, text) in enumerate(zip(part.column("rid").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    data = text.encode()
                    # a row of docs that is there twice has each of its runs twice
                    f, one = np.unique(first[bounds[k] : bounds[k + 1]], return_index=True)
                    one += bounds[k]
                    end = f + starts[one] - 1 + core.LENGTH
                    low = int(key[one].min())
                    # a stretch ends where the next run lies apart, or where it is long
                    fresh = np.append(True, (f[1:] > end[:-1]) | (f[1:] // longest != f[:-1] // longest))
                    cuts = [*np.flatnonzero(fresh).tolist(), len(f)]
                    for a, z in zip(cuts, cuts[1:], strict=False):
                        head = int(f[a])
                        rows.append((low, rid, head, data[head : int(end[z - 1])], key[one[a:z]].tobytes(), np.stack([f[a:z] - head, starts[one[a:z]]]).astype("<i4").tobytes(), often[one[a:z]].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _shards(parts: int, most: int, hold: int):
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    schema = pa.schema([(n, pa.int64()) for n in ("place", "part", "rid", "a", "z")] + [(n, pa.binary()) for n in ("prints", "tags", "offsets")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, size, rows = TaskContext.get().partitionId() << 32, 0, []
        held: list[tuple] = []  # of the shards so far: first places of stretches, their rids and first bytes, fingerprints, tags, offsets

        def table(shard: list[tuple]) -> None:
            nonlocal size
            rid, first = (np.array([x[k] for x in shard], np.int64) for k in (0, 1))
            length = np.array([len(x[2]) + 1 for x in shard], np.int64)
            base = np.cumsum(length) - length
            again, prints, tags, offsets = _solve([x[2] for x in shard], base, *list(zip(*shard, strict=True))[3:])
            owner = np.searchsorted(base, again, side="right") - 1
            for o, a, z in zip(*(x.tolist() for x in _intervals(again, owner)), strict=True):
                rows.append((None, None, int(rid[o]), a - int(base[o]) + int(first[o]), z - int(base[o]) + int(first[o]), None, None, None))
            held.append((base + size, rid, first, prints, tags, offsets + size))
            size += int(length.sum())

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal place, size, held
            if held:
                base, rid, first, prints, tags, offsets = (np.concatenate(x) for x in zip(*held, strict=True))
                by = np.argsort(prints)
                prints, tags, offsets = prints[by], tags[by], offsets[by].astype("<u4")
                cut = [0, *np.searchsorted(prints, bounds).tolist(), len(prints)]
                for part, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
                    if a < z:
                        rows.append((place, part, None, None, None, prints[a:z].tobytes(), tags[a:z].tobytes(), offsets[a:z].tobytes()))
                if len(prints):
                    rows.append((place, None, None, None, None, None, np.stack([base, rid]).tobytes(), first.tobytes()))
                place, size, held = place + 1, 0, []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows.clear()

        shard: list[tuple] = []
        amount = 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("rid", "first", "data", "keys", "offsets", "often")), strict=True):
                if shard and amount + len(x[2]) + 1 > most:
                    table(shard)
                    shard, amount = [], 0
                    if sum(len(x[3]) for x in held) >= hold or len(rows) >= 1 << 16 or size >> 31:
                        yield from send()
                shard.append(x)
                amount += len(x[2]) + 1
        if shard:
            table(shard)
        yield from send()

    return run


def _solve(data: list[bytes], base: np.ndarray, keys: tuple, offsets: tuple, often: tuple) -> tuple[np.ndarray, ...]:
    """One shard: its repeated starts, and fingerprint, tag and place of each different start that other shards may have."""
    text = np.frombuffer(b"".join(x + b"\0" for x in data), np.uint8)
    runs = np.array([len(k) // 8 for k in keys], np.int64)
    key = np.frombuffer(b"".join(keys), np.int64)
    n = np.frombuffer(b"".join(often), np.int64)
    both = [np.frombuffer(o, "<i4").reshape(2, -1) for o in offsets]
    start = np.concatenate([b[0] for b in both]) + np.repeat(base, runs)
    count = np.concatenate([b[1] for b in both]).astype(np.int64)
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count, -1)
    again, lead = core.repeated(text, np.cumsum(edge[:-1]) > 0)
    # an anchor that the corpus has as often as this shard is in no other shard
    _, which, here = np.unique(key, return_inverse=True, return_counts=True)
    elsewhere = here[which] < n
    edge[:] = 0
    np.add.at(edge, start[elsewhere], 1)
    np.add.at(edge, (start + count)[elsewhere], -1)
    offset = np.flatnonzero(lead & (np.cumsum(edge[:-1]) > 0))
    prints = core.mix(core.rolling(text, core.LENGTH)[offset]) if len(offset) else np.empty(0, np.uint64)
    tags = key[np.searchsorted(start, offset, side="right") - 1].astype("<u2")
    return np.flatnonzero(again), prints, tags, offset


def _intervals(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, first, last)`` of the maximal runs of consecutive numbers of one owner."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    return owner[head], at[head], at[np.append(head[1:], len(at)) - 1] if len(at) else at


def _search(table: pa.Table) -> pa.Table:
    """One range of fingerprints: which of them more than one sender has, found by binary search."""
    sent = [np.frombuffer(x, np.uint64) for x in table.column("prints").to_pylist()]
    tags = [np.frombuffer(x, "<u2") for x in table.column("tags").to_pylist()]
    every = np.concatenate(sent)
    by = np.argsort(every)
    merged, tag = every[by], np.concatenate(tags)[by]
    rows = []
    for place, mine, own, offsets in zip(table.column("place").to_pylist(), sent, tags, table.column("offsets").to_pylist(), strict=True):
        lo, hi = np.searchsorted(merged, mine), np.searchsorted(merged, mine, side="right")
        hit = hi - lo > 1
        # equal strings have equal anchors too: the tags tell most chance meetings of fingerprints apart
        for k in np.flatnonzero(hit).tolist() if len(tag) and (tag[lo[hit]] != tag[hi[hit] - 1]).any() else ():
            hit[k] = (tag[lo[k] : hi[k]] == own[k]).sum() > 1
        if hit.any():
            rows.append({"place": place, "offsets": np.frombuffer(offsets, "<u4")[hit].tobytes()})
    return pa.Table.from_pylist(rows, pa.schema([("place", pa.int64()), ("offsets", pa.binary())]))


def _settle(told: pa.Table, back: pa.Table) -> pa.Table:
    """Offsets of one sender, turned into starts of its texts."""
    schema = pa.schema([(n, pa.int64()) for n in ("rid", "a", "z")])
    if not told.num_rows or not back.num_rows:
        return schema.empty_table()
    base, rid = np.frombuffer(told.column("tags")[0].as_py(), np.int64).reshape(2, -1)
    first = np.frombuffer(told.column("offsets")[0].as_py(), np.int64)
    at = np.sort(np.concatenate([np.frombuffer(x, "<u4") for x in back.column("offsets").to_pylist()]).astype(np.int64))
    owner, a, z = _intervals(at, np.searchsorted(base, at, side="right") - 1)
    return pa.table([rid[owner], a - base[owner] + first[owner], z - base[owner] + first[owner]], schema=schema)


def _cut(with_text: bool, carry: tuple[str, ...]):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = b"" if text is None else text.encode()
                kept, at, cuts = [], 0, 0
                for a, z in sorted((s["a"], s["z"]) for s in spans or ()):
                    if a > at or not cuts:
                        kept.append(data[at:a])
                        cuts += 1
                    at = max(at, z)
                kept.append(data[at:])
                rest = b"".join(kept)
                row = [len(data), len(data) - len(rest), cuts, hashlib.sha256(rest).hexdigest()]
                if with_text:
                    row.append(None if text is None else rest.decode("utf-8", "ignore"))
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True)), *(batch.column(c) for c in carry)], [*names, *carry])

    return run
