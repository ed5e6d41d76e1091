from pyspark.sql import functions as F

from codexlake.functions.headings import roman
from codexlake.functions.text import strip
from codexlake.operators.pages import PAGE_NUMBER, clean_pages


def clean(spark, *pages):
    return clean_pages(spark.createDataFrame([(1, "\f".join(pages))], "doc_id long, text string")).first()["text"]


def test_edges_that_run_through_go(spark):
    pages = [f"Harbour Guide\nBerth {k} lies east of the mole.\n\n  {k + 40}  " for k in range(5)]
    assert clean(spark, *pages) == "\n".join(f"Berth {k} lies east of the mole.\n" for k in range(5))


def test_the_same_line_inside_a_page_stays(spark):
    got = clean(spark, "Tides\nThe moon pulls.\n7", "Tides\nHigh water\nTides\nLow water\n8", "Tides\nSlack water\nix", "Currents\nDrift\nx")
    assert got.split("\n") == ["The moon pulls.", "High water", "Tides", "Low water", "Slack water", "Currents", "Drift"]


def test_half_of_the_pages_are_not_enough(spark):
    assert clean(spark, "Head\na", "Head\nb", "c", "d") == "Head\na\nHead\nb\nc\nd"


def test_a_line_alone_on_its_page_counts_once(spark):
    # one vote a page: Sole has two of four
    assert clean(spark, "Sole", "Sole", "a\nb", "c\nd") == "Sole\nSole\na\nb\nc\nd"
    assert clean(spark, "Sole", "Sole", "Sole", "c\nd") == "c\nd"


def test_few_pages_and_empty_ones(spark):
    assert clean(spark, "Cover\nanchor-\nage\n2") == "Cover\nanchorage\n2"
    assert clean(spark, "one\n1", "two\n2") == "one\n1\ntwo\n2"
    assert clean(spark, "", "", "p\nq", "") == "p\nq"
    assert clean(spark, "1", "2", "3") == ""


def test_page_numbers(spark):
    good = [f(roman(n)) for n in range(1, 100) for f in (str.lower, str.upper)] + ["7", "2049", " 12 "]
    bad = ["", "20490", "C", "CI", "IIX", "VV", "LIVID", "MIMIC", "page 3", "1.", "-4"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", strip(F.col("x")).rlike(PAGE_NUMBER).alias("hit")).collect()
    assert [r["x"] for r in rows if r["hit"]] == good
