import json

import pytest

from codexlake.operators import corpus, merge


def sources(spark, rows):
    kind = "corpus string, source_ord int, path string, filename string, format string, method string, size_bytes long, pages int, images_dropped int, text string"
    return spark.createDataFrame(rows, kind)


def row(k, text, corpus_="c", **over):
    r = {"format": "text", "method": "plain-text", "images": None} | over
    return (corpus_, k, f"/x/{k}", f"f{k}", r["format"], r["method"], 1048576, 2, r["images"], text)


def test_metadata_of_several_sources(spark):
    filler = "filler line\n" * 4000
    for order in (1, -1):
        texts = [filler + "Chapter 1\n", "Table of Contents\nChapter 1\nChapter 2\n"][::order]
        got = corpus.metadata(sources(spark, [row(0, texts[0]), row(1, texts[1], format="epub", images=3)]), "corpus").first()
        assert got["has_toc"] and got["chapters_detected"] == 2 and got["filename"] == "multi-source" and got["format"] == "mixed"
        assert got["images_dropped"] == 3 and got["pages"] == 4 and got["file_size_mb"] == 2.0 and [s["filename"] for s in got["sources"]] == ["f0", "f1"]


def test_one_source_and_banner_neutrality(spark):
    text = "# A\n\n## x\n\n## y\n"
    got = corpus.metadata(sources(spark, [row(0, text)]), "corpus").first()
    assert (got["filename"], got["format"], got["chapters_method"], got["chapters_detected"], got["no_toc"]) == ("f0", "text", "structural", 2, True)
    whole = corpus.consolidate(sources(spark, [row(0, text)]), "corpus").first()["text"]
    assert whole.startswith("=" * 80 + "\nSOURCE: f0 (Path: /x/0)") and whole.endswith("## y")


def test_failures_stay_in_their_rows(spark):
    rows = sources(spark, [row(0, "good"), row(1, " ​ "), row(2, None)])
    assert [r["source_ord"] for r in corpus.usable(rows).collect()] == [0]
    assert sorted(r["source_ord"] for r in corpus.failures(rows).collect()) == [1, 2]


def test_write(spark, tmp_path):
    rows = sources(spark, [row(0, "a b"), row(0, "c", corpus_="d")])
    corpus.write_corpus(rows, "corpus", str(tmp_path / "out"))
    found = [json.loads(x) for f in (tmp_path / "out/metadata").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["corpus"] for x in found) == ["c", "d"]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        corpus.write_corpus(rows, "corpus", str(tmp_path / "out"))


def test_merges(spark):
    old = spark.createDataFrame([("b", 1), ("a", 2)], "term string, ref int")
    new = spark.createDataFrame([("b", 3), ("b", 1), ("c", 4)], "term string, ref int")
    assert [tuple(r) for r in merge.merge_references(old, new).collect()] == [("a", [2]), ("b", [1, 3]), ("c", [4])]
    have, more = spark.createDataFrame([(4,)], "number int"), spark.createDataFrame([("y",), ("x",)], "name string")
    assert [(r["name"], r["number"]) for r in merge.number_new(have, more, "name").orderBy("name").collect()] == [("x", 5), ("y", 6)]
