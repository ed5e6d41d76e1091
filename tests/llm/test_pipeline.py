"""The pipeline's stages: each against brute force on what the stage before kept, and on odd tables."""

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codexlake.llm import mixing, packing, quality, stages
from codexlake.llm.stages import COLUMNS

from .test_operators import DOC, grouped, prose, shingles, water

SF = "/root/testdata/sf0.001"


def removed(texts):
    """Texts without the bytes that a 200-byte string covers which starts twice or more."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = [r.asDict() for r in docs.collect()]
        verdict = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()} if name == "quality" else {}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == COLUMNS and all(r["n_chars"] == len(r["text"]) for r in got)
        if name == "quality":
            want = [r for r in given if verdict[r["doc_id"]]]
            assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) < len(given)
        elif name == "near_dedup":
            sets = {r["doc_id"]: shingles(r["text"]) for r in given}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert sorted(r["doc_id"] for r in got) == sorted(i for i, top in grouped(sorted(sets), links).items() if i == top)
        elif name == "suffix_dedup":
            assert {r["doc_id"]: r["text"] for r in got} == dict(zip((r["doc_id"] for r in given), removed([r["text"] for r in given]), strict=True))
        elif name == "mixing":
            size = Counter()
            for r in given:
                size[r["source"]] += len(r["text"].encode().split())
            order = sorted(size)
            target = water(size, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
            taken, texts = Counter(), {r["doc_id"]: r["text"] for r in given}
            for r in got:
                taken[r["source"]] += len(r["text"].encode().split())
                assert texts[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split()
            assert all(abs(taken[s] - target[s]) <= 1 for s in order) and max(Counter(r["doc_id"] for r in got).values()) <= 3
        else:
            library = Tokenizer.from_file(packing.public_tokenizer())
            want = Counter((r["doc_id"], zlib.crc32(np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in given)
            rows = {}
            for p in got:
                rows.setdefault(p["row"], []).append(p)
            assert len(rows) == len(given)
            for pieces in rows.values():
                pieces.sort(key=lambda p: p["start"])
                assert [p["start"] for p in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))] and sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"]
            whole = Counter((v[0]["doc_id"], v[0]["ids_crc32"]) for v in rows.values() if len(v) == 1)
            assert whole and not whole - want and Counter(v[0]["doc_id"] for v in rows.values()) == Counter(r["doc_id"] for r in given)
            full = Counter()
            for p in got:
                full[p["sequence_id"]] += p["length"]
            assert sorted(full.values())[1:] == [2048] * (len(full) - 1)


def test_packing_follows_the_training_order(spark, tmp_path):
    rng = random.Random(21)
    rows = [(k, prose(rng, rng.randrange(20, 60)), "en", "abc"[min(2, k // 60)], 0) for k in range(200)]  # c, the last, weighs most and is small
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    due = {}
    for r in mixing.mix(docs).collect():
        for turn in range(1, r["passes"] + (r["extra"] > 0) + 1):
            part = min(1.0, (r["start"] + (turn - 1) * r["source_size"] + r["size"] / 2) / max(r["target"], 1.0))
            position = 2 * part / (r["ramp"] + max(0.0, r["ramp"] ** 2 + 4 * (1 - r["ramp"]) * part) ** 0.5)
            due.setdefault(r["source"], []).append((position, r["h"], r["doc_id"]))
    stages.mixing(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    got = stages.packing(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    repeats = 0
    for s, want in due.items():
        mine = [r for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["source"] == s and r["start"] == 0]
        assert [r["doc_id"] for r in mine] == [d for _, _, d in sorted(want)]
        # copies of a document lie a whole pass of its source apart
        place, kinds = {}, len({r["doc_id"] for r in mine})
        for k, r in enumerate(mine):
            if r["doc_id"] in place:
                repeats += 1
                assert k - place[r["doc_id"]] >= kinds - 1
            place[r["doc_id"]] = k
    assert repeats > 20


def test_odd_tables(spark, tmp_path):
    rng = random.Random(22)
    base = prose(rng, 300)
    rows = [(k, prose(rng, 80), "en", f"s{k % 3}", 0) for k in range(30)]
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (None, prose(rng, 70), "en", "s1", 0), (None, None, None, None, None), (102, base, "en", "s1", 0), (103, base, "en", "s2", 0), (5, base, "en", "s2", 0)]
    rows += [rows[0], rows[0], (104, prose(rng, 30_000), "en", "s0", 0)]
    clash = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOC + ", _row string, _h int, turn int, position string")
    clash.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(8)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = [r.asDict() for r in docs.collect()]
    kept = {str((r["doc_id"], r["text"])) for r in seen["quality"]}
    near = seen["near_dedup"]
    # of the rows with the long repeated text one stays, that of the smallest id; the other text of that id is a document of its own
    same = [r["doc_id"] for r in near if r["text"] == base]
    assert same == [min(i for i in (5, 102, 103) if str((i, base)) in kept)] if any(str((i, base)) in kept for i in (5, 102, 103)) else not same
    assert Counter(str((r["doc_id"], r["text"])) for r in near if r["doc_id"] is not None).most_common(1)[0][1] == 1
    assert sum(r["doc_id"] is None for r in near) == sum(r["doc_id"] is None for r in seen["quality"])
    assert all((r["text"] is None) == (r["n_chars"] is None) for r in seen["suffix_dedup"]) and len(seen["suffix_dedup"]) == len(near)
    assert all(r["text"] for r in seen["mixing"])  # a document without words is taken no times
    assert sum(r["length"] for r in seen["packing"]) == sum({r["row"]: r["doc_tokens"] for r in seen["packing"]}.values())


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
