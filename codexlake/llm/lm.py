"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_slices, starts_of, with_columns_of

#: Token classes: 0 outside a text, then the most frequent words, then hashed rest; neighbours a side; hidden units.
CLASSES, FREQUENT, SIDE, HIDDEN = 128, 95, 2, 16
#: Tokens to a gradient step, and words a task counts before it sends its counts.
STEP, COUNTED = 2048, 1 << 19
#: Words (about) of a group that learns from one start, and of a slice of it that steps are drawn from.
GROUP, SLICE = 1 << 21, 1 << 18
#: Words of at least one in LISTED of all, so that many at most (some 25 MB; by their usual distribution a tenth), are handed to the tasks with their counts; the counts of all others are joined.
LISTED = 1 << 20
#: What a word that no other document has counts as.
UNSEEN = 0.001
#: Models of groups that one task adds up.
FAN = 32
_AROUND = [d for d in range(-SIDE, SIDE + 1) if d]


class Network:
    """Class probabilities of the masked token: embeddings of each neighbour by place, tanh, softmax."""

    def __init__(self, flat: np.ndarray | None = None) -> None:
        shapes = [(len(_AROUND), CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
        size = [int(np.prod(s)) for s in shapes]
        if flat is None:
            rng = np.random.default_rng(11)
            flat = (rng.standard_normal(sum(size)) * 0.1).astype(np.float32)
        self.flat = flat.astype(np.float32).copy()
        cut = np.cumsum([0, *size])
        self.place, self.hidden, self.out, self.bias = (self.flat[a:b].reshape(s) for a, b, s in zip(cut, cut[1:], shapes, strict=False))
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def _forward(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pre = self.hidden + self.place[0][tokens[at + _AROUND[0]]]
        for k, d in enumerate(_AROUND[1:], 1):
            pre += self.place[k][tokens[at + d]]
        h = np.tanh(pre)
        z = h @ self.out
        z += self.bias
        return h, z

    def log_probabilities(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, z = self._forward(tokens, at)
        own = z[np.arange(len(at)), tokens[at]].copy()
        top = z.max(axis=1)
        z -= top[:, None]
        np.exp(z, out=z)
        return own - top - np.log(z.sum(axis=1))

    def learn(self, tokens: np.ndarray, at: np.ndarray, rate: float = 0.01) -> None:
        h, z = self._forward(tokens, at)
        z -= z.max(axis=1)[:, None]
        np.exp(z, out=z)
        z /= z.sum(axis=1)[:, None]
        z[np.arange(len(at)), tokens[at]] -= 1
        z /= len(at)
        back = (z @ self.out.T) * (1 - h * h)
        place = np.empty_like(self.place)
        for k, d in enumerate(_AROUND):
            near = tokens[at + d]
            for u in range(HIDDEN):
                place[k, :, u] = np.bincount(near, weights=back[:, u], minlength=CLASSES)
        g = np.concatenate([place.ravel(), back.sum(axis=0), (h.T @ z).ravel(), z.sum(axis=0)])
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.flat -= rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def _bucket(word: bytes) -> int:
    return 1 + FREQUENT + zlib.crc32(word) % (CLASSES - 1 - FREQUENT)


class Classes(dict):
    """Class of each lower-cased word; rare words share classes by a checksum."""

    def __init__(self, frequent: list[bytes]) -> None:
        super().__init__({w: k + 1 for k, w in enumerate(frequent)})
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
            self.update({w: k + 1 for k, w in enumerate(self.frequent)})
        found = self[word] = _bucket(word)
        return found


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob, perplexity)`` for every row of ``docs``.

    Words are counted over all whole texts; the most frequent are classes of their own.  Each text is then
    written once as its classes, a byte a word.  The network is learned on all documents in two rounds,
    each on the groups of one parity: groups are dealt by a hash of id and text and hold about GROUP words, a group runs
    through its documents in the order of the hash from the same start, and the groups' weights, averaged by
    tokens in a tree, start the next round.  So the model doesn't depend on how the table is partitioned.
    ``log_prob`` sums the log probability of each token given the tokens on both of its sides: that
    of its class by the network, and that of the word in its class by the counts of all other documents: a
    document's own words are left out, so a word that only it has is as unlikely as a new one, and UNSEEN
    stands for a count of nothing.  The table of counts grows with the corpus and is joined with the words of each row; words too frequent to
    meet in one task are handed to the tasks instead, with the same counts.

    * null or word-less text: 0 tokens, log_prob 0, mean and perplexity null.
    * null ids and repeated rows: as any row.  Empty table: empty result.  Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    plain = with_columns_of(docs, id_col, text_col).toDF("doc_id", "text")
    counts = scratch.save(plain.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    most = {bytes(r["word"]): r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()}
    frequent = list(most)
    buckets = _bucket_sums(counts, most)
    total = sum(most.values()) + sum(buckets.values())
    listed = {bytes(r["word"]): r["n"] for r in counts.where(F.col("n") * LISTED >= total).collect()}
    # written first: a row's number is that of the one run that was kept
    told = plain.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(
        _classes(frequent, listed, buckets), "row long, doc_id long, h long, classes binary, known double, rare array<binary>, times array<int>"
    )
    told = scratch.save(told)
    flat = Network().flat
    groups = 2 * max(1, -(-total // (2 * GROUP)))
    dealt = told.where(F.length("classes") > 0).select("h", "classes", F.pmod("h", F.lit(groups)).alias("task"))
    for turn in (0, 1):
        sent = scratch.save(dealt.where(F.col("task") % 2 == turn).groupBy("task").applyInArrow(_train(flat), "task long, n double, w binary"))
        flat = _average(sent, flat)
        scratch.drop(sent)
    scored = told.select("row", "doc_id", "classes", "known").mapInArrow(_score(flat), "row long, doc_id long, n_tokens long, log_prob double")
    others = counts.where(F.col("n") * LISTED < total)
    more = told.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), "w.times")
    more = more.join(others, "word").groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n") - F.col("times") + UNSEEN)).alias("more"))
    whole = scored.join(more, "row", "left")
    whole = whole.select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return whole.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))


def _bucket_sums(counts: DataFrame, most: dict[bytes, int]) -> dict[int, int]:
    """How many words of all texts each checksum class has: the frequent words, classes of their own, are not in it."""
    bucket = F.lit(1 + FREQUENT) + F.pmod(F.crc32("word"), F.lit(CLASSES - 1 - FREQUENT))
    sums = {r["bucket"]: r["n"] for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()}
    for word, n in most.items():
        sums[_bucket(word)] -= n
    return sums


def _average(sent: DataFrame, before: np.ndarray) -> np.ndarray:
    most = sent.agg(F.max("task").alias("k")).first()["k"]
    if most is None:
        return before
    while True:
        sent = sent.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task").applyInArrow(_add, "task long, n double, w binary")
        most //= FAN
        if not most:
            break
    row = sent.first()
    return (np.frombuffer(row["w"], np.float64) / row["n"]).astype(np.float32) if row and row["n"] else before


def _add(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["w"]))
    w = np.sum([np.frombuffer(r["w"], np.float64) for r in rows], axis=0)
    return pa.table({"task": [rows[0]["task"]], "n": [sum(r["n"] for r in rows)], "w": [w.tobytes()]})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for part in row_slices(batch, "text"):
            for text in part.column("text").to_pylist():
                total.update(text.encode().lower().split() if text else ())
            if len(total) > COUNTED:
                yield send()
    if total:
        yield send()


def _classes(frequent: list[bytes], listed: dict[bytes, int], buckets: dict[int, int]):
    """Numbered rows with the class of each word, the log share of ``listed`` words in their classes (of others, without their counts), and those others with how often they occur."""
    of_class = np.zeros(CLASSES)
    for c, n in buckets.items():
        of_class[c] = math.log(max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(frequent)
        own = listed | dict.fromkeys(frequent, 0)
        get, count, log = classes.__getitem__, own.get, math.log
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in row_slices(batch, "text"):
                found, known, rare, times = [], [], [], []
                for text in part.column("text").to_pylist():
                    words = text.encode().lower().split() if text else []
                    c = np.fromiter(map(get, words), np.uint8, len(words))
                    found.append(c.tobytes())
                    total, others, often = 0.0, [], []
                    for w, k in Counter(words).items():
                        n = count(w)
                        if n is None:
                            others.append(w)
                            often.append(k)
                        elif n:
                            total += k * log(n - k + UNSEEN)
                    rare.append(others)
                    times.append(often)
                    known.append(total - float(of_class @ np.bincount(c, minlength=CLASSES)))
                starts = pa.array(starts_of(map(len, rare)).astype(np.int32))
                flat = [pa.ListArray.from_arrays(starts, pa.array(list(chain.from_iterable(x)), k)) for x, k in ((rare, pa.binary()), (times, pa.int32()))]
                kinds = [pa.int64(), None, None, pa.binary(), pa.float64(), None, None]
                cols = [np.arange(row, row + len(found)), part.column("doc_id"), part.column("h"), found, known, *flat]
                yield pa.RecordBatch.from_arrays([c if k is None else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row", "doc_id", "h", "classes", "known", "rare", "times"])
                row += len(found)

    return run


def _tokens(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts with SIDE zeros before, between and after them; places and number of each text's."""
    n = np.array([len(c) for c in found], np.int64)
    gap = bytes(SIDE)
    out = np.frombuffer(gap + b"".join(c + gap for c in found), np.uint8)
    first = np.cumsum(n + SIDE) - n
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return out, at, n


def _train(start: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        net, seen = Network(start), 0
        # rows equal in both are the same, so the order is one for every partitioning
        order = sorted(zip(table.column("h").to_pylist(), table.column("classes").to_pylist(), strict=True))
        while order:
            some, size = [], 0
            while order and (not some or size < SLICE):
                some.append(order.pop()[1])
                size += len(some[-1])
            tokens, at, _ = _tokens(some)
            steps = max(1, len(at) // STEP)
            for k in range(steps):  # each step takes tokens from all of the slice
                net.learn(tokens, at[k::steps])
            seen += len(at)
        return pa.table({"task": pa.array([table.column("task")[0].as_py()], pa.int64()), "n": [float(seen)], "w": pa.array([(net.flat.astype(np.float64) * seen).tobytes()], pa.binary())})

    return run


def _score(flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat)
        for batch in batches:
            for part in row_slices(batch, "classes", SLICE):
                tokens, at, n = _tokens(part.column("classes").to_pylist())
                p = np.concatenate([net.log_probabilities(tokens, at[k : k + STEP]) for k in range(0, len(at), STEP)]) if len(at) else np.empty(0)
                total = np.bincount(np.repeat(np.arange(len(n)), n), weights=p, minlength=len(n)) + part.column("known").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(n), pa.array(total)], ["row", "doc_id", "n_tokens", "log_prob"])

    return run
