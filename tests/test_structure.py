from pyspark.sql import functions as F

from codexlake.operators import structure as S

LONG = "word " * 60


def detect(spark, *texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in S.detect(docs).collect()}


def test_methods(spark):
    r = detect(
        spark, "Chapter 1 Introduction\nSome text.\nChapter 2 Details\nMore.\nChapter 2\n", "# Book\n\n## Alpha\na\n\n## Beta\nb\n", "nothing here", "", "Alpha\n=====\na\nBeta\n=====\nb\n",
        "# The Document\n" + "".join(f"## {k}. Title\n{LONG}\n" for k in (1, 2, 3)), "# Book\n" + "".join(f"## {k}. Step\nshort\n" for k in (1, 2, 3)),
        "# Book\n\n## 5 Setup\na\n\n## 6 Teardown\nb\n\n## Real One\nc\n",
    )
    got = [(r[k]["chapters_detected"], r[k]["chapters_method"]) for k in range(8)]
    assert got == [(2, "numeric"), (2, "structural"), (0, "none"), (0, "none"), (2, "structural"), (3, "structural"), (1, "structural"), (2, "structural")]
    assert r[0]["chapter_headings_sample"] == ["Chapter 1 Introduction", "Chapter 2 Details", "Chapter 2"]


def test_fences(spark):
    open_ = "# Handbook\n## Alpha\na\n## Beta\n```\nOptions\n-------\n## Gamma\ng\n## Delta\nd\n"
    r = detect(spark, open_, open_.replace("-------\n", "-------\n```\n"), "~~~\n# A\n```\n# B\n~~~\n## C\n## D\n")
    assert [r[k]["chapters_detected"] for k in range(3)] == [5, 4, 2]


def test_setext_needs_a_title(spark):
    r = detect(spark, "a\n\n---\n\nb\n---\nc\n----\n", "| a | b |\n===== =====\n\n=====\n=====\n", "---\ntitle: x\n---\n")
    # a line shorter than its underline is a title; one longer is not
    assert [r[k]["chapters_detected"] for k in range(3)] == [2, 0, 0]


def test_segments_and_costs(spark):
    body = "Contents\nChapter 1\nChapter 2\n\nChapter 1\n" + "w " * 900 + "\nChapter 2\n" + "v " * 300
    docs = spark.createDataFrame([(1, body), (2, "Chapter 1\nx"), (3, "plain")], "doc_id long, text string")
    segs = S.segments(docs)
    front = {r["doc_id"]: r["body"] for r in segs.where("seg_id = 0").collect()}
    assert front == {1: "Contents", 2: "", 3: "plain"}
    best = {(r["doc_id"], r["number"]): r["tokens"] for r in S.best_chapters(segs).collect()}
    assert best == {(1, 1): int(902 / 0.75), (1, 2): int(302 / 0.75), (2, 1): 4}
    cost = {r["doc_id"]: r for r in S.discovery_cost(docs).collect()}
    assert set(cost) == {1, 2} and cost[1]["target"] == 2
    assert cost[1]["loop"] == cost[1]["toc"] + 402 + 1202 and cost[1]["skill"] == 5000 and cost[2]["vs_dump"] == "0.0x"


def test_headings_told_by_the_caller(spark):
    docs = spark.createDataFrame([(1, "a\nChvi. Chier\nb\nChapter 2\nc")], "doc_id long, text string")
    number = lambda s: F.regexp_extract(s, r"^Chapter (\d{1,2})\z", 1).try_cast("int")
    told = lambda **k: [(r["seg_id"], r["number"], r["body"]) for r in S.segments(docs, **k).orderBy("seg_id").collect()]
    assert told() == [(0, None, "a"), (1, 6, "Chvi. Chier\nb"), (2, 2, "Chapter 2\nc")]
    assert told(number=number) == [(0, None, "a\nChvi. Chier\nb"), (1, 2, "Chapter 2\nc")]
