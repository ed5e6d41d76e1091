"""Queries against their SQL on small tables that hold what only large ones of the driver's do."""

import duckdb
import pytest

from codexlake.plans import catalog


def twins(spark, folder, name, **tables):
    """Rows of the query and of its SQL, in order, over tables of ``(rows, schema)``."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    told = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(told, key=repr)


def test_html_text_scanner_on_cut_references(spark, tmp_path):
    texts = ("a &amp;&amp", "a &am", "a &#39", "a &lt", "&copy; a &amp;amp; b&middot;", "&quo &quot;&amp;quot;")
    pages = [(k, f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>{t}</p></body></html>") for k, t in enumerate(texts)]
    got, told = twins(spark, tmp_path, "html_text_scanner", pages=(pages, "page_id long, html string"))
    assert got == told and len(got) == len(texts)


#: Invented words that read as headings, before and after chapters of their numbers, and one line that is a heading.
TEXTS = ("one two\nChvi. Chier épaen, eaumentou ètreré. Êchoi de.\nthree " + "w " * 90, "V. A b\nChi\nx", "plain", "  Chapter 7 \ny z", "Kapitel 41\nu v", "第三章 开始\nt", "a\n" * 700)


def documents(texts):
    return [(k, t, "src0" if k < 4 else "src10") for k, t in enumerate(texts)], "doc_id long, text string, source string"


@pytest.mark.parametrize("name", ["chapter_segments", "best_chapter", "chapter_headings_sample", "discovery_tax"])
def test_books_with_lines_that_read_as_headings(spark, tmp_path, name):
    got, told = twins(spark, tmp_path, name, documents=documents(TEXTS))
    assert got == told and got


def test_corpora_with_lines_that_read_as_headings(spark, tmp_path):
    # this SQL reads no texts for chapters, so none holds one here
    got, told = twins(spark, tmp_path, "corpus_structure", documents=documents([t for t in TEXTS if "Chapter" not in t]))
    assert got == told and got


@pytest.mark.parametrize("name", ["skill_validation", "skill_validation_amp", "skill_validation_copilot"])
def test_bundles_with_long_files(spark, tmp_path, name):
    got, told = twins(spark, tmp_path, name, documents=([(k, "l\n" * (600 * (k % 2)), "s") for k in range(40)], "doc_id long, text string, source string"))
    assert got == told and got
