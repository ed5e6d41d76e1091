"""The operators against brute force on small tables, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from codexlake.llm import embedding, html, langid, lm, minhash, mixing, packing, quality, rules, suffix
from codexlake.llm.common import Scratch
from codexlake.llm.graph import components
from codexlake.llm.prefix import running_totals

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (400, 150, 60, 30, 9)]
    texts = [*base, *(near(rng, base[0], k) for k in (1, 3, 6, 9, 14, 20) for _ in range(6)), *(near(rng, base[1], k) for k in (1, 2, 4) for _ in range(3)), base[1], base[1].upper(), base[1].replace(" ", "\t\n")]
    texts += [prose(rng, rng.randrange(1, 300)) for _ in range(30)] + [None, "", " \n ", "one", "One", "two words", "é " * 400, prose(rng, 30_000)]
    rows = [(k, t, "en", f"s{k % 4}" if k % 7 else None, 0) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, base[0], "en", "s1", 0)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, "clash", 1) for r in corpus], DOC + ", digest string, m int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def grouped(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [256, 3])
def test_minhash(docs, corpus, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    sets = {r[0]: shingles(r[1]) for r in corpus if r[0] is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = grouped(ids, links)
    got = minhash.minhash_dedup(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_classes_of_different_components_meet(spark):
    rng = random.Random(2)
    rows = [(band, rep, rep if rng.random() < 0.4 else -1) for band, n in ((1, 40), (2, 7), (3, 15)) for rep in range(band * 100, band * 100 + n)]
    frame = []
    for band in (1, 2, 3):
        mine = [r for r in rows if r[0] == band]
        count = Counter(r[2] for r in mine)
        main, big = max(count.items(), key=lambda x: (x[1], x[0]))
        frame += [(rep, of, b, -(-big // 4), -(-(len(mine) - big) // 4), of == main) for b, rep, of in mine]
    got = minhash._dealt(spark.createDataFrame(frame, "rep long, of long, band long, wide long, tiles long, is_main boolean")).collect()
    tiles = {}
    for r in got:
        tiles.setdefault((r["band"], r["i"], r["j"]), []).append((r["rep"], r["of"]))
    met = {(a[0], b[0]) for t in tiles.values() for a in t for b in t if a[0] < b[0] and a[1] != b[1]}
    assert met == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]}


def test_band_rows():
    assert [minhash.band_rows(p) for p in (80, 85, 100)] == [7, 8, 20]


def test_components(spark):
    links = [(9, 8), (8, 7), (7, 1), (5, 4), (3, 3), (20, 21), (21, 22), (22, 23), (23, 20), (30, 40), (50, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {n: c for n, c in grouped(range(51), links).items() if n in {x for p in links for x in p} - {3}}


@pytest.mark.parametrize("shard", [None, 3000])
def test_suffix(spark, monkeypatch, shard):
    if shard:  # many shards, several of them to a sender
        monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
        monkeypatch.setattr(suffix, "HELD", 4000)
    rng = random.Random(1)
    passage, base = prose(rng, 60), prose(rng, 200)
    texts = [base, near(rng, base, 2), "ab" * 300, "ab" * 150 + "c" * 500, None, "", "x" * 199, "x" * 250, "é" * 90 + passage, "è" + passage[3:], passage[:199], base]
    texts += [f"head {k} " * (k % 7 + 1) + passage[k % 9 :] + f" tail{k} " * 5 for k in range(25)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[0])]
    count = Counter(b[k : k + 200] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i if i is not None else -1, len(b), sum(gone), sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest()))
    got = suffix.suffix_dedup(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)).collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == sorted(want)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding, "TILE", 7)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    x = np.concatenate([base, base[[0] * 9 + [1] * 6] + rng.standard_normal((15, 16)) * np.linspace(0, 0.5, 15)[:, None], base[[3, 3]] * 7])
    label = rng.integers(0, 2, len(x))
    rows = [(k, [float(v) for v in x[k]], int(label[k])) for k in range(len(x))]
    odd = [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [1.0, None], 0), (104, [float(v) for v in x[0]], None), (105, [1.0, 2.0], int(label[0])), (106, [], 0)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    want = grouped(range(len(x)), zip(*np.nonzero(link), strict=True))
    got = embedding.embedding_dedup(spark.createDataFrame([*rows, *odd, (None, rows[0][1], int(label[0]))], "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) + 1 and link.sum() > 20
    assert all((by[k]["n_links"], by[k]["component_id"], by[k]["kept"]) == (link[k].sum(), want[k], want[k] == k) for k in range(len(x)))
    assert all((by[k]["n_links"], by[k]["component_id"], by[k]["kept"]) == (0, k, True) for k in range(100, 107)) and by[None]["component_id"] is None


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    x = embedding._unit(rng.standard_normal((200, 48)))
    q, s, n, e = embedding.quantise(x)
    near_ = (q.astype(float) @ q.T) * s[:, None] * s[None, :]
    assert (np.abs(near_ - x @ x.T) <= e[:, None] * n[None, :] + e[None, :] * n[:, None] + e[:, None] * e[None, :]).all()


def water(sizes, weights):
    share, capped = {}, set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_mixing(docs, corpus, empty, monkeypatch):
    for slot in (1 << 20, 500):
        monkeypatch.setattr(mixing, "SLOT", slot)
        got = mixing.in_training_order(mixing.mix(docs)).collect()
        assert len(got) == len(corpus)
        sizes = Counter()
        for r in corpus:
            sizes[r[3]] += len((r[1] or "").encode().split())
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = water(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)})
        for s in order:
            mine = [r for r in got if r["source"] == s]
            assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
            assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1 and all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        at = [r["position"] for r in got]
        assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


def test_water_with_caps(spark):
    rows = [(k, "w " * n, "en", s, 0) for k, (s, n) in enumerate([("a", 900), ("b", 5), ("c", 10), ("d", 300)])]
    got = {r["source"]: r for r in mixing.mix(spark.createDataFrame(rows, DOC)).collect()}
    want = water({"a": 900, "b": 5, "c": 10, "d": 300}, {"a": 1, "b": 2, "c": 3, "d": 1})
    assert {s: round(r["target"], 6) for s, r in got.items()} == {s: round(v, 6) for s, v in want.items()}
    assert got["b"]["taken"] == 15 and got["c"]["taken"] == 30


def test_running_totals(spark):
    rows = [(s, p, p % 7 + 1) for s in ("a", None) for p in range(0, 3000, 3)]
    for r in running_totals(spark.createDataFrame(rows, "k string, p long, v long"), "k", "p", "v", "t").collect():
        assert r["t"] == sum(q % 7 + 1 for q in range(0, r["p"], 3))


def test_packing(docs, corpus, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLICE", 20_000)
    path = packing.public_tokenizer()
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = Counter()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    ids = {}
    for r in corpus:
        ids.setdefault(r[0], []).append([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])
        want[r[0]] += len(ids[r[0]][-1])
    assert {k: sum(r["length"] for r in v) for k, v in pieces.items()} == dict(want)
    for k, v in pieces.items():
        if len(ids[k]) == 1:
            at = 0
            for r in sorted(v, key=lambda r: r["start"]):
                raw = np.array(ids[k][0][at : at + r["length"]], "<u4").tobytes()
                assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(raw), len(ids[k][0]))
                at += r["length"]
    full = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == full[r["sequence_id"]]
        full[r["sequence_id"]] += r["length"]
    assert sorted(full.values())[1:] == [2048] * (len(full) - 1) and max(full.values()) <= 2048
    assert packing.pack(empty, path).count() == 0


def test_windows_are_filled_to_proportion(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 1 << 14)
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.choice([3, 40, 900])), "en", rng.choice(["a"] * 8 + ["b"] * 4 + ["c", "d", None]), 0) for k in range(400)] + [(1000, prose(rng, 9000), "en", "b", 0), (1001, "tiny", "en", "e", 0)]
    got = packing.pack(spark.createDataFrame(rows, DOC).repartition(5), packing.public_tokenizer()).collect()
    total, windows = Counter(), {}
    for r in got:
        total[r["source"]] += r["length"]
        windows.setdefault(r["sequence_id"], Counter())[r["source"]] += r["length"]
    every = sum(total.values())
    assert len(windows) > 60 and every > 3 << 14
    for k, w in windows.items():
        if k < len(windows) - 1:
            # what a queue holds back or sends ahead is under LEAST tokens, at either end of a window
            assert all(abs(w[s] - 2048 * n / every) <= 2 * packing.LEAST + 2 for s, n in total.items()), (k, w)


def test_packing_order(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(k % 50, f"{k % 50} " + prose(rng, 30) if k < 50 else None, "en", "ab"[k % 2], 99 - k) for k in range(100)]
    got = packing.pack(spark.createDataFrame(rows, DOC).repartition(4), packing.public_tokenizer(), order=(F.col("n_chars"),)).collect()
    for s in "ab":
        mine = [r for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["source"] == s]
        at = [r["row"] for r in mine]
        assert at == sorted(at) and len(set(at)) == 50
        assert [r["doc_id"] for r in mine if r["start"] == 0] == [k % 50 for k in range(99, -1, -1) if "ab"[k % 2] == s]


def test_rounds_carry_deficits():
    share, first, last = [0.5, 0.3, 0.2], [1000, 600, 400], [6000, 3600, 2400]
    who, since, count = packing.rounds(share, first, last, 2000)
    sent = list(first)
    for q, a, n in zip(who.tolist(), since.tolist(), count.tolist(), strict=True):
        assert a == sent[q] and n > 0
        sent[q] += n
        done = sum(sent)
        assert all(abs(x - s * done) <= packing.WINDOW for x, s in zip(sent, share, strict=True))
    assert sent == last


def test_tokens_are_the_librarys():
    from codexlake.llm.tokens import WordTokenizer

    t = WordTokenizer(packing.public_tokenizer())
    texts = ["it's DON'T we'll x'S ''s 'RE", "İstanbul Σας ΣΑΣ é ﬁ ½ ²", "<|endoftext|> a<|startoftext|>b <|x", "中文 mixed中文abc123", "", "  \x1c a\x1cb \x85 c d", "co-op 3.14 #$%&* ÀÉß Ÿ ÿ×÷", "a" * 3000]
    assert t.fast
    assert [np.frombuffer(x, t.kind).tolist() for x in t.ids(texts)] == [t.library.encode(x, add_special_tokens=False).ids for x in texts]


def test_empty_tables(empty, spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert minhash.minhash_dedup(empty).count() == suffix.suffix_dedup(empty).count() == embedding.embedding_dedup(vectors).count() == 0


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(31)
    long = prose(rng, 500_000)  # over two slices of numpy's
    assert len(long) > 2 << 20
    passage = long[1_500_000:1_500_400]
    rows = [(1, long, "en", "s", 0), (2, "x " * 50 + passage + " y" * 50, "en", "s", 0), (3, "short and alone", "en", "s", 0)]
    got = {r["doc_id"]: r for r in suffix.suffix_dedup(spark.createDataFrame(rows, DOC)).collect()}
    text = {k: t.encode() for k, t, *_ in rows}
    count = Counter(hash(t[k : k + 200]) for t in text.values() for k in range(len(t) - 199))
    for k, t in text.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[hash(t[i : i + 200])] > 1:
                gone[i : i + 200] = b"\1" * 200
        assert (got[k]["n_bytes"], got[k]["n_removed"]) == (len(t), sum(gone)) and got[k]["kept_sha256"] == hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()
    assert got[2]["n_removed"] >= 400


def test_starts_pass_through_the_merge(spark):
    """At production parameters: copies that fill several shards, and a passage that shards of different texts share."""
    from pyspark.sql import functions as F

    rng = random.Random(32)
    base, passage = prose(rng, 60_000), prose(rng, 80)
    rows = [(k, base) for k in range(8)] + [(100 + k, prose(rng, 2000) + passage) for k in range(6)] + [(200 + k, base[1000 * k : 1000 * k + 3000] + prose(rng, 50)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "t")
    found = suffix.shards(suffix.pieces(docs.withColumn("rid", F.xxhash64("doc_id", "text")), scratch), scratch)
    starts = lambda df: df.agg(F.sum(F.col("z") - F.col("a") + 1).alias("n")).first()["n"] or 0
    assert found.where("prints is not null").count() > 1
    assert starts(suffix.merged(found, scratch)) > 100_000  # each shard's first of a string is known by the others alone
    got = {r["doc_id"]: r for r in suffix.suffix_dedup(docs).collect()}
    assert all(got[k]["n_removed"] == len(base) and got[k]["n_spans"] == 1 for k in range(8))
    assert all(got[100 + k]["n_removed"] >= len(passage) and got[200 + k]["n_removed"] >= 3000 for k in range(6))


def test_extra_columns_that_clash(spark, corpus):
    from pyspark.sql import functions as F

    names = "rid row h n ids part within at key slot own digest band m words size passes task evidence host path kept component node u v classes known rare".split()
    frame = spark.createDataFrame([r for r in corpus if len(r[1] or "") < 5000], DOC)
    odd = frame.withColumns({c: F.lit("clash") for c in names})
    path = packing.public_tokenizer()
    runs = (
        lambda d: minhash.minhash_dedup(d), lambda d: suffix.suffix_dedup(d), lambda d: mixing.mix(d).drop("h"), lambda d: packing.pack(d, path).groupBy("doc_id").agg(F.sum("length")), lambda d: langid.identify(d).select("doc_id", "held_out"),
        lambda d: rules.quality_rules(d), lambda d: lm.pseudo_likelihood(d).select("doc_id", "n_tokens"),
        lambda d: quality.classify(d, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), F.col("source"), F.col("lang")).select("doc_id"),
    )
    for run in runs:
        assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(frame).collect()))


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_null_ids_in_quality(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(None, "some text here", "en", "s", 0), (None, None, None, None, 0), (1, "more text", "en", "s", 0)], DOC)
    told = spark.createDataFrame([(None, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, told, F.col("source"), F.col("lang")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "None", "None"]


def test_decoding_chooses_the_nearest_codeword():
    import math

    rng = np.random.default_rng(5)
    code = langid.codewords(6)
    bits = code.shape[1]
    model = {"w": np.eye(bits), "b": rng.standard_normal(bits), "code": code, "weight": rng.random(bits) / bits}
    x = rng.standard_normal((40, bits)) * 3
    best, score, unsure = langid.decode(model, x)
    for k in range(40):
        far = [sum(w * math.log1p(math.exp(-c * (m + b))) for w, c, m, b in zip(model["weight"], word, x[k], model["b"], strict=True)) for word in code]
        near = sorted(range(6), key=far.__getitem__)
        assert best[k] == near[0] and unsure[k] == (far[near[1]] - far[near[0]] < langid.GAP)
        assert score[k] == pytest.approx(1 / sum(math.exp((far[near[0]] - f) * bits) for f in far))


def test_posteriors_by_hand(spark):
    rng = random.Random(11)
    rows = [(f"h{k % 5}" if k % 11 else None, f"p{k % 3}", rng.random() ** (1 + k % 5)) for k in range(300)]
    got = {(r["h"], r["p"]): r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}

    def sums(key):
        out = {}
        for h, p, e in rows:
            n, g = out.get(key(h, p), (0, 0.0))
            out[key(h, p)] = n + 1, g + e
        return out

    def strength(sites):
        n, g = sum(s[0] for s in sites), sum(s[1] for s in sites)
        mean = g / n
        between = max(sum(s[1] ** 2 / s[0] for s in sites) / n - mean**2 - mean * (1 - mean) * len(sites) / n, 1e-9)
        return min(quality.STRONGEST, max(1.0, mean * (1 - mean) / between - 1))

    paths, hosts = sums(lambda h, p: (h, p)), sums(lambda h, p: h)
    prior, hk, pk = sum(e for *_, e in rows) / len(rows), strength(hosts.values()), strength(paths.values())
    assert set(got) == set(paths)
    for (h, p), (n, g) in paths.items():
        host = (hosts[h][1] + hk * prior) / (hosts[h][0] + hk)
        assert got[h, p]["host_posterior"] == pytest.approx(host) and got[h, p]["path_posterior"] == pytest.approx((g + pk * host) / (n + pk))


def test_language_codes():
    for k in (1, 2, 4, 5, 6, 12, 40):
        code = langid.codewords(k)
        assert len({tuple(c) for c in code}) == k
        if k > 5:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3


def test_ngrams_of_pieces_are_those_of_the_whole(monkeypatch):
    rng = random.Random(41)
    texts = [prose(rng, 900) + " é ß " + prose(rng, 300), "a", "", "ab" * 700]
    whole = langid.ngrams(texts)
    for size in (1000, 7, 3):
        monkeypatch.setattr(langid, "BATCH_BYTES", size)
        assert np.allclose(langid.ngrams(texts), whole, atol=1e-6)


def test_languages(spark, empty):
    rng = random.Random(3)
    kinds = {"aa": "the of and ing tion", "bb": "der und sch ung ein", "cc": "le que eau ment eux"}
    rows = []
    for k in range(240):
        lang = sorted(kinds)[k % 3]
        rows.append((k, " ".join("".join(rng.choices(kinds[lang].split(), k=rng.randrange(1, 4))) for _ in range(40)), lang, "s", 0))
    rows += [(1000, None, "aa", "s", 0), (1001, "12 34 !!", "aa", "s", 0), (1002, "the and of ing the", None, "s", 0), (None, "der und ung sch", "aa", "s", 0)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(240))
    assert all(got[r[0]]["lang_pred"] == r[2] and 0 <= got[r[0]]["score"] <= 1 for r in rows[:240])
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002, None)] == ["und", "und", "aa", "bb"] and got[None]["held_out"] is False
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "abc", None, "s", 0)], DOC)).collect()} == {"und"}


def test_quality(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(200):
        good = k % 4 > 0
        text = prose(rng, 80) if good else " ".join(w + "###" for w in prose(rng, 80).split())
        rows.append((k, text, "en", None if k % 10 == 0 else f"h{k % 5}", 0))
        labels.append((k, int(good), 0))
    from pyspark.sql import functions as F

    told = spark.createDataFrame([*labels[:150], (None, 1, 0), (3, None, 0), labels[0]], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (500, None, None, None, 0)], DOC)
    got = {r["doc_id"]: r for r in quality.classify(docs, told, F.col("source"), F.col("lang")).collect()}
    assert all(got[k]["kept"] == bool(good) for k, good, _ in labels) and 500 in got
    none = quality.classify(docs, told.where("doc_id < 0"), F.col("source"), F.col("lang")).collect()
    assert all(r["kept"] and r["evidence"] == 0.5 for r in none)
    assert quality.classify(empty, told, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(f"h{k % 4}", "p", 0.9 if k % 4 else 0.2) for k in range(400)] + [("h1", "rare", 0.01)]
    got = {(r["h"], r["p"]): r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    assert got["h0", "p"]["path_posterior"] < 0.3 and got["h1", "p"]["path_posterior"] > 0.85
    assert 0.01 < got["h1", "rare"]["path_posterior"] < got["h1", "rare"]["host_posterior"]


def brute_rules(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    words = "".join(" " if c in space else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + d for k in range(len(words) - 2) for d in range(3) if windows[tuple(words[k : k + 3])] > 1}
    lines = [x for x in text.split("\n") if x.strip(space)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rules(docs, corpus, spark, empty):
    extra = [(900, "a b c a b c d\na b c a b c d\n \n", "x", "y", 0), (901, "word### " * 80, "x", "y", 0), (902, "<a|b> é\x0bc\x85d e", "x", "y", 0), (903, "A a. " * 3, "x", "y", 0)]
    rng = random.Random(6)
    for k, n in enumerate((2100, 19_999, 20_000, 50_000)):  # few words, at whatever length
        extra.append((904 + k, " ".join(f"word{rng.randrange(60)}" for _ in range(n)), "x", "y", 0))
    extra.append((908, "one | two | three " * 40 + prose(rng, 100).replace(" ", " | "), "x", "y", 0))
    extra.append((909, prose(rng, 60_000), "x", "y", 0))
    more = spark.createDataFrame(extra, DOC)
    got = rules.quality_rules(docs.select("doc_id", "text", "lang", "source", "n_chars").union(more)).collect()
    want = Counter()
    for r in [*corpus, *extra]:
        c = brute_rules(r[1])
        want[r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[k] for k in (904, 905, 906, 907, 908)) and kept[909]
    assert kept[0] and not kept[901] and not kept[900] and not any(r["kept"] for r in got if r["base_failed"])
    assert rules.quality_rules(empty).count() == 0


def test_language_model(docs, corpus, spark, empty):
    got = lm.pseudo_likelihood(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r[0], len((r[1] or "").encode().split())) for r in corpus)
    assert all(r["log_prob"] < 0 and r["perplexity"] > 1 if r["n_tokens"] else (r["log_prob"] == 0 and r["perplexity"] is None) for r in got)
    assert lm.pseudo_likelihood(empty).count() == 0


@pytest.mark.parametrize("listed", [1 << 17, 1])
def test_rare_words_have_their_own_probability(spark, monkeypatch, listed):
    monkeypatch.setattr(lm, "LISTED", listed, raising=False)  # at 1 the count of every word is joined
    rare = next([a, b] for a in WORDS for b in WORDS if a < b and zlib.crc32(a.encode()) % 32 == zlib.crc32(b.encode()) % 32)
    frequent = " ".join(f"common{k}" for k in range(95))
    texts = [*[frequent] * 6, f"common1 {rare[0]} common2", f"common1 {rare[1]} common2", f"{rare[0]} {rare[0]} {rare[0].upper()} {rare[0]}", None]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in lm.pseudo_likelihood(spark.createDataFrame(rows, DOC).coalesce(1)).collect()}
    # the other documents have the one four times, the other never
    assert got[6]["log_prob"] - got[7]["log_prob"] == pytest.approx(np.log((4 + lm.UNSEEN) / lm.UNSEEN))
    assert got[6]["perplexity"] == pytest.approx(np.exp(-got[6]["log_prob"] / 3)) and got[9]["perplexity"] is None
    assert len(got) == len(rows)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 3000)
    rng = random.Random(12)
    rows = [(k, prose(rng, rng.randrange(1, 400)) if k % 50 else None, "en", "s", 0) for k in range(120)]
    frame = spark.createDataFrame(rows, DOC)
    a, b = ({r["doc_id"]: r["log_prob"] for r in lm.pseudo_likelihood(frame.repartition(n)).collect()} for n in (2, 16))
    assert a == pytest.approx(b, rel=1e-6) and len(set(a.values())) > 100


def test_scores_by_hand():
    words = "a b c d e f g h rare rare2".split()
    frequent, listed = [w.encode() for w in words[:4]], {w.encode(): 10 + k for k, w in enumerate(words[4:8])}
    buckets = Counter()
    for w, n in [*listed.items(), (b"rare", 2), (b"rare2", 3)]:
        buckets[lm._bucket(w)] += n
    texts = ["a b e rare c e", "", "h g f", "rare2 rare a"]
    flat = np.random.default_rng(4).standard_normal(lm.Network().flat.size).astype(np.float32) * 0.3
    import pyarrow as pa

    from codexlake.llm.lm import CLASSES, HIDDEN, SIDE

    class At:  # the numbering of rows asks for the task
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    original, lm.TaskContext.get = lm.TaskContext.get, staticmethod(lambda: At)
    try:
        told = next(lm._classes(frequent, listed, buckets)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(4)), "text": texts, "h": list(range(4))})])))
    finally:
        lm.TaskContext.get = original
    got = next(lm._score(flat)(iter([told]))).to_pydict()
    net = lm.Network(flat)
    for text, p, n, rare in zip(texts, got["log_prob"], got["n_tokens"], told.to_pydict()["rare"], strict=True):
        ws = [w.encode() for w in text.split()]
        cls = [frequent.index(w) + 1 if w in frequent else lm._bucket(w) for w in ws]
        want = 0.0
        for k, w in enumerate(ws):
            h = net.hidden.astype(float).copy()
            for j, d in enumerate(x for x in range(-SIDE, SIDE + 1) if x):
                h += net.place[j][cls[k + d] if 0 <= k + d < len(ws) else 0]
            z = np.tanh(h) @ net.out + net.bias
            want += z[cls[k]] - np.log(np.exp(z).sum())
            if w not in frequent:
                want += (np.log(listed[w] - ws.count(w) + lm.UNSEEN) if w in listed else 0.0) - np.log(buckets[cls[k]])
        assert n == len(ws) and p == pytest.approx(want, abs=1e-4) and sorted(rare) == sorted(w for w in ws if w.startswith(b"rare"))
        assert len(h if ws else [0] * HIDDEN) == HIDDEN and CLASSES <= 256


def test_network_gradient_learns_both_sides():
    rng = np.random.default_rng(0)
    left = rng.integers(1, 20, 6000)
    tokens = np.zeros(18_004, np.int64)
    tokens[2:-2:3], tokens[4:-2:3] = left, rng.integers(1, 20, 6000)
    tokens[3:-2:3] = (tokens[2:-2:3] + tokens[4:-2:3]) % 20 // 10 + 50  # told by both neighbours only
    at = np.arange(3, 18_002, 3)
    net = lm.Network()
    before = net.log_probabilities(tokens, at).mean()
    for k in range(300):
        net.learn(tokens, at[k % 4 :: 4], rate=0.02)
    assert net.log_probabilities(tokens, at).mean() > before + 3.5


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var a="</p>";</script></head><body><header class="site-header"><p>Brand</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div><article><h1>The  title&amp;more</h1><p><b>First   para<br><p>Second &lt;x&gt; para, with\n some length to it.</p></article>
<aside class="sidebar"><a href="/c">Related</a></aside><section class="comments"><p>Great post!</p></section><form><p>Sign up</p></form><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", PAGE)]
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    want = "The title&more\nFirst para\nSecond <x> para, with some length to it."
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and got[None]["text"] == want
    assert (got[2]["text"], got[3]["text"], got[2]["n_chars"]) == ("", "", 0)
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_labeller_on_pages_it_has_not_seen():
    from codexlake.llm import html_training as T

    writer, right, total = T._Writer(np.random.default_rng(1234)), 0, 0
    for _ in range(200):
        page, truth = T.labelled(writer)
        if page:
            right, total = right + (html.label([page], html._model())[0] == truth).sum(), total + len(page)
    assert right / total > 0.97


# pages written by hand, not by the generator that the network is trained with; main text, block by block
BY_HAND = [
    (
        """<!doctype html><html><head><title>Rivers | The Almanac</title><style>b{}</style></head><body><div id="page"><div class="top-bar"><a href="/">The Almanac</a> <a href="/login">Sign in</a></div>
<ul class="main-menu"><li><a href="/w">World</a><li><a href="/s">Science</a><li><a href="/a">Arts</a></ul>
<div class="entry-content"><h1>How rivers choose their course</h1><p>A river rarely runs straight. Water that leaves a bend moves faster on the outside, where it cuts the bank, and slower on the inside, where it drops sand.</p>
<p>Over centuries the bend grows into a loop. In a flood the water breaks through the neck, and the loop is left behind as a <em>lake</em>.</p><h2>Why it matters</h2><ul><li>Bridges outlive the channel they were built for.</li><li>Borders drawn along a river may move.</li></ul>
<div class="advert">Sponsored: save 20% on walking boots this week only</div><p>Engineers once answered with concrete; today they more often give the river room.</p></div>
<div class="related-posts"><h3>You may also like</h3><a href="/1">Lakes that vanish overnight</a> <a href="/2">Maps of the old delta</a></div><div id="footer"><p>Copyright 2019 The Almanac. All rights reserved.</p></div></div></body></html>""",
        ["How rivers choose their course", "A river rarely runs straight. Water that leaves a bend moves faster on the outside, where it cuts the bank, and slower on the inside, where it drops sand.", "Over centuries the bend grows into a loop. In a flood the water breaks through the neck, and the loop is left behind as a lake.", "Why it matters", "Bridges outlive the channel they were built for.", "Borders drawn along a river may move.", "Engineers once answered with concrete; today they more often give the river room."],
    ),
    (
        """<html><body><div><p>We use cookies to improve your experience. <a href=#>Accept all</a></p></div><main><h1>Bread without kneading</h1><p>Stir flour, water, salt and very little yeast, and leave the dough alone for a night.<p>In the morning fold it twice, let it rest for an hour, and bake it in a closed pot.
<pre>500 g flour
400 g water</pre></main><section><h2>Comments</h2><div class="comment"><p>Thanks, this was really helpful.</p></div><div class="comment"><p>Mine was too wet, what did I do wrong?</p></div></section><form action=/nl><p>Subscribe to our newsletter</p><input type=email><button>Go</button></form><footer><a href=/i>Imprint</a></footer></body></html>""",
        ["Bread without kneading", "Stir flour, water, salt and very little yeast, and leave the dough alone for a night.", "In the morning fold it twice, let it rest for an hour, and bake it in a closed pot.", "500 g flour 400 g water"],
    ),
    (
        """<body><header><h2>Stadtbote</h2><nav><a href=/>Startseite</a> <a href=/k>Kontakt</a></nav></header><div class="wrapper"><article><h1>Neue Brücke im Hafen</h1><p>Die Stadt öffnet am Montag die neue Brücke für den Verkehr. Der Bau hat vier Jahre gedauert.</p><blockquote><p>Wir sind früher fertig als geplant, sagt der Leiter der Arbeiten.</p></blockquote><p>Die alte Fähre fährt noch bis zum Ende des Sommers.</p></article>
<aside class="sidebar"><h3>Meistgelesen</h3><ul><li><a href=/1>Streit um den Markt</a></li><li><a href=/2>Regen im Juli</a></li></ul></aside></div><footer>&copy; Stadtbote Verlag. Impressum</footer></body>""",
        ["Neue Brücke im Hafen", "Die Stadt öffnet am Montag die neue Brücke für den Verkehr. Der Bau hat vier Jahre gedauert.", "Wir sind früher fertig als geplant, sagt der Leiter der Arbeiten.", "Die alte Fähre fährt noch bis zum Ende des Sommers."],
    ),
]


def test_pages_written_by_hand():
    from codexlake.llm.html_blocks import blocks

    hit = found = there = 0
    for page, want in BY_HAND:
        leaf = blocks(page)
        got = [b.text for b, ok in zip(leaf, html.label([leaf], html._model())[0], strict=True) if ok]
        hit, found, there = hit + len(set(got) & set(want)), found + len(got), there + len(want)
    assert hit / there >= 0.95 and hit / found >= 0.85, (hit, found, there)


def test_every_word_of_a_block_is_read():
    from codexlake.llm.html_blocks import Block, spoken

    long = " ".join(f"word{k}" for k in range(300))
    a, b = spoken([Block(long + " reply", ("p",), 0), Block(long + " bridge", ("p",), 0)])
    assert (a != b).any() and spoken([Block("...", ("p",), 0)]).sum() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p>one <a title="bad>two</a><p class="x">three</p>', ["one three"]),  # the value runs to the next quote
        ('<p>one</p><a title="bad>two', ["one"]),  # or to the end
        ("<p class=a\" id=x>one</p>", ["one"]),  # no value starts here
        ("<!--><p>one</p><!-- > two --><p>three</ p><p>4 < 5</p>", ["one", "three", "4 < 5"]),
        ("<p title='a>b' data-x=\">\">one</p>", ["one"]),
    ],
)
def test_quotes_and_comments(page, want):
    from codexlake.llm.html_blocks import blocks

    assert [b.text for b in blocks(page)] == want


def test_a_page_longer_than_a_slice(spark):
    many = "".join(f"<p>Paragraph {k} of the article, with some words in it.</p>" for k in range(30_000))
    got = html.main_text(spark.createDataFrame([(1, "u", f"<html><body><nav><a href=/>Home</a></nav><article>{many}</article></body></html>")], "page_id long, url string, html string")).first()
    assert got["text"].count("\n") == 29_999


@pytest.mark.parametrize("start", ["<html><head><title>t</title><body>", "<head><meta charset=x><style>p{}</style>", "<html><head><title>t</title></head><body>", "<head><script>a</script><head>"])
def test_open_head_and_formulas(start):
    from codexlake.llm.html_blocks import blocks

    page = blocks(start + "<p>One <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x = 1</annotation></math> two</p><p>Three</p>")
    assert [b.text for b in page] == ["One x=1 two", "Three"]
    assert [b.text for b in blocks("<head><title>t</title>Text first<p>Then")] == ["Text first", "Then"]
