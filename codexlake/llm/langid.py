"""Language identification with error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, row_slices, with_columns_of

#: Documents to learn from (about, all languages together), hashed n-gram features, least bits of a code.
SAMPLE, FEATURES, BITS = 2400, 4096, 15
#: A codeword this little nearer than the next is flagged.
GAP = 0.05
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` for every row of ``docs``.

    Fold 0, ``crc32(doc_id as text) mod folds = 0``, is held out; SAMPLE documents with a language, spread
    evenly over the languages of the other folds by a hash, are learned from.  Each bit of the languages'
    codewords has a logistic classifier over hashed 1- to 3-byte n-grams of the whole text; a text gets the
    language whose codeword has the least loss, bits weighted by how well they were learned.  ``score`` is
    that language's share of the decoding weight; ``ambiguous``: the next codeword is about as near.

    * null text or one without a letter: ``und``, score 0.  No language to learn from: ``und`` throughout.
    * null id: in no fold: neither held out nor learned from.  Repeated rows: each is returned.
    * empty table: empty result.  Extra columns of ``docs`` are ignored.
    """
    plain = with_columns_of(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    model = learn(plain.where((fold != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    told = plain.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return told.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def learn(labelled: DataFrame) -> dict:
    # one row a language reaches the driver, and its share of the sample is a literal there: the texts aren't shuffled
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {"langs": []}
    each = SAMPLE / len(counts)
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = labelled.where(draw < F.element_at(share, F.col("lang")))
    rows = some.select("doc_id", "lang", "text").mapInArrow(_features, "doc_id long, lang string, f binary").dropDuplicates().collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["f"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return {"langs": []}
    x = np.stack([np.frombuffer(r["f"], np.float16) for r in rows]).astype(np.float32)
    y = np.searchsorted(langs, [r["lang"] for r in rows])
    code = codewords(len(langs))
    w, b = logistic(x, code[y])
    margin = x @ w + b
    right = (np.sign(margin) == code[y]).mean(axis=0)
    weight = np.log((right + 0.01) / (1.01 - right + 0.01)).clip(0.1)
    return {"langs": langs, "code": code.astype(np.float32), "w": w, "b": b, "weight": (weight / weight.sum()).astype(np.float32)}


def codewords(k: int) -> np.ndarray:
    """``k`` rows of +1 and -1, far from each other; no column is constant.

    Up to 5 languages: every way to split them in two.  Beyond: the best of many random codes.
    """
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        split = np.arange(1, 1 << (k - 1))
        return np.where((split[None, :] >> np.arange(k)[:, None]) & 1, 1.0, -1.0)
    rng, bits = np.random.default_rng(7), max(BITS, math.ceil(10 * math.log2(k)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, bits))
        flat = np.abs(code.sum(axis=0)) == k
        code[0, flat] *= -1
        apart = bits - code @ code.T
        least = (apart + 4 * bits * np.eye(k)).min()
        if least > far:
            best, far = code, least
    return best


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of one logistic classifier a column of ``y`` (+1 or -1), by Adam over all rows."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    y = y.astype(np.float32)
    for t in range(1, rounds + 1):
        slope = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        for p, g, a, c in ((w, x.T @ slope + decay * w, m, v), (b, slope.sum(axis=0), mb, vb)):
            a += 0.1 * (g - a)
            c += 0.01 * (g * g - c)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.99**t)) + 1e-8)
    return w, b


#: Bytes as the n-grams see them: letters lower-cased, all other ASCII a space.
_SEEN = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def ngrams(texts: list[str]) -> np.ndarray:
    """``(len(texts), FEATURES)``: square roots of hashed n-gram counts of whole texts, of length 1."""
    out = np.zeros((len(texts), FEATURES), np.float64)
    for k, text in enumerate(texts):
        raw = b" " + text.encode().translate(_SEEN) + b" "
        for c in range(0, len(raw), BATCH_BYTES):  # a piece has the n-grams that start in it, and so two bytes more
            part = np.frombuffer(raw[c : c + BATCH_BYTES + 2], np.uint8).astype(np.uint32)
            one = part[:BATCH_BYTES]
            two = (part[:-1] * np.uint32(257) + part[1:])[:BATCH_BYTES]
            three = (part[:-2] * np.uint32(257) + part[1:-1]) * np.uint32(257) + part[2:]
            for n, g in ((1, one), (2, two), (3, three)):
                h = ((g + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
                out[k] += np.bincount(h, minlength=FEATURES)
    out = np.sqrt(out)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_slices(batch, "text", BATCH_BYTES // 8):
            f = ngrams(part.column("text").to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([x.tobytes() for x in f], pa.binary())], ["doc_id", "lang", "f"])


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and ambiguity of each row of features."""
    margin = x @ model["w"] + model["b"]
    loss = np.logaddexp(0, -margin[:, None, :] * model["code"][None, :, :])
    far = (loss * model["weight"]).sum(axis=2)
    best = far.argmin(axis=1)
    near = np.exp(-(far - far.min(axis=1, keepdims=True)) * model["code"].shape[1])
    score = near.max(axis=1) / near.sum(axis=1)
    second = np.sort(far, axis=1)[:, 1] if far.shape[1] > 1 else np.full(len(far), np.inf)
    return best, score, second - far.min(axis=1) < GAP


def _predict(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", BATCH_BYTES // 8):
                texts = part.column("text").to_pylist()
                lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                at = [k for k, t in enumerate(texts) if t and model["langs"] and _LETTER.search(t)]
                if at:
                    best, s, u = decode(model, ngrams([texts[k] for k in at]))
                    score[at], unsure[at] = s, u
                    for k, b in zip(at, best.tolist(), strict=True):
                        lang[k] = model["langs"][b]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
                )

    return run
