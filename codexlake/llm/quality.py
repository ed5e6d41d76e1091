"""Quality classification with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_slices
from .langid import logistic
from .rules import base_counts

#: Labelled documents to learn from (about), and the strongest prior that a variance estimate may give.
SAMPLE, STRONGEST = 4000, 10_000.0
_MARKS = b"#*$%&|!?.,;:<>\"'()[]{}@/\\-_=+~^"
FEATURES = len(_MARKS) + 9
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, repetition and length of a whole text."""
    raw = text.encode() if text else b""
    c = base_counts(text)
    words, size = max(1, c["n_words"]), max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    marks = np.sqrt(count[list(_MARKS)] / words)
    upper, lower, digit = (count[list(k)].sum() for k in (_UPPER, _LOWER, _DIGIT))
    distinct = len(set(raw.lower().split())) / words
    other = [
        upper / max(1, upper + lower), np.sqrt(digit / size), count[128:].sum() / size, c["n_repeat_words"] / words, c["n_dup_lines"] / max(1, c["n_lines"]),
        np.log1p(c["n_words"]) / 10, np.log1p(c["word_chars"] / words), distinct, np.log1p(words / max(1, c["n_lines"])) / 5,
    ]
    return np.concatenate([marks, other]).astype(np.float32)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_id: Column | None = None) -> DataFrame:
    """``(doc_id, evidence, host_posterior, path_posterior, score, kept)`` for every row of ``docs``.

    ``evidence``: the probability of good quality by a logistic classifier of the text alone, learned from
    about SAMPLE rows of ``labels(doc_id, quality)`` drawn by a hash, repeated rows once.  Hosts have a Beta prior around the
    mean evidence of all documents, its strength from the variance between hosts; a path has one around
    its host's posterior.  Sites with few documents so stay near what stands above them.  ``score`` moves
    a document's log odds by those of its path against all; documents under ``threshold`` aren't kept.

    * null or empty text: features of an empty text.  No usable labels: evidence 0.5, all kept.
    * null host or path: a site of its own.  Null ids: scored, never learned from.
    * ``label_id``: the id that labels know, where it isn't ``id_col``.
    * labels that repeat an id: their mean decides; null labels are passed over.
    * repeated rows: each is returned.  Empty table: empty result.  Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host.alias("host"), path.alias("path"), (F.col(id_col) if label_id is None else label_id).alias("label_id"))
    seen = scratch.save(plain.mapInArrow(_measure, "doc_id long, host string, path string, label_id long, f array<float>"))
    model = learn(seen, labels)
    scored = scratch.save(seen.mapInArrow(_score(model), "doc_id long, host string, path string, evidence double"))
    site = posteriors(scored)
    joined = scored.join(site, scored["host"].eqNullSafe(site["h"]) & scored["path"].eqNullSafe(site["p"]), "left")
    odds = lambda x: F.log(x / (1 - x))
    total = odds(F.col("evidence")) + odds(F.col("path_posterior")) - odds(F.col("prior"))
    score = 1 / (1 + F.exp(-total))
    return joined.select("doc_id", "evidence", "host_posterior", "path_posterior", score.alias("score"), (score >= threshold).alias("kept"))


def posteriors(scored: DataFrame) -> DataFrame:
    """``(h, p, host_posterior, path_posterior, prior)`` of each path of ``scored(host, path, evidence)``."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    top = hosts.agg((F.sum("hgood") / F.sum("hn")).alias("prior"), _strength(F.col("hn"), F.col("hgood")).alias("hk"), F.sum("hn").alias("all"))
    below = paths.agg(_strength(F.col("n"), F.col("good")).alias("pk"))
    # one row each, of sums over everything
    hosts = hosts.join(F.broadcast(top), F.lit(True))
    hosts = hosts.withColumn("host_posterior", (F.col("hgood") + F.col("hk") * F.col("prior")) / (F.col("hn") + F.col("hk")))
    sites = paths.withColumnRenamed("host", "ph").join(hosts, F.col("ph").eqNullSafe(F.col("host"))).join(F.broadcast(below), F.lit(True))
    path = (F.col("good") + F.col("pk") * F.col("host_posterior")) / (F.col("n") + F.col("pk"))
    return sites.select(F.col("ph").alias("h"), F.col("path").alias("p"), "host_posterior", path.alias("path_posterior"), "prior")


def _strength(n: Column, good: Column) -> Column:
    """Beta prior's weight in documents, by moments: the variance of site means beyond chance."""
    mean = F.sum(good) / F.sum(n)
    spread = F.sum(good * good / n) / F.sum(n) - mean * mean
    chance = mean * (1 - mean) * F.count("*") / F.sum(n)
    between = F.greatest(spread - chance, F.lit(1e-9))
    return F.least(F.lit(STRONGEST), F.greatest(F.lit(1.0), mean * (1 - mean) / between - 1))


def learn(seen: DataFrame, labels: DataFrame) -> dict | None:
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    share = SAMPLE / max(SAMPLE, told.count())
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = seen.join(told.where(draw < share).withColumnRenamed("doc_id", "l"), F.col("label_id") == F.col("l")).select("label_id", "f", "quality").dropDuplicates().collect()
    rows.sort(key=lambda r: (r["label_id"], list(r["f"])))
    if len({r["quality"] >= 0.5 for r in rows}) < 2:
        return None
    x = np.array([r["f"] for r in rows], np.float32)
    y = np.array([[1.0 if r["quality"] >= 0.5 else -1.0] for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    w, b = logistic((x - mean) / scale, y, rounds=400, rate=0.05, decay=1e-3)
    return {"mean": mean, "scale": scale, "w": w[:, 0], "b": float(b[0])}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_slices(batch, "text"):
            f = [features(t) for t in part.column("text").to_pylist()]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * FEATURES, pa.int32()), pa.array(np.concatenate(f), pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), part.column("label_id"), flat], ["doc_id", "host", "path", "label_id", "f"])


def _score(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            p = np.full(len(x), 0.5)
            if model is not None:
                z = ((x - model["mean"]) / model["scale"]) @ model["w"] + model["b"]
                p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
            p = p.clip(1e-6, 1 - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(p)], ["doc_id", "host", "path", "evidence"])

    return run
