from pyspark.sql import functions as F

from codexlake.functions import markup as M

CASES = {
    "<h2>Chapter 1</h2>Intro": "Chapter 1\nIntro", "<p>a</p>\n<p>b</p>": "a\nb", "a<b>b</b>c": "abc", "<div><div><p>x</p></div></div>": "x", "a<br>b<br/>c": "a\nb\nc",
    "<table><tr><td>Chapter 1</td><td>Intro</td></tr><tr><td>&nbsp;</td><td>z</td></tr></table>": "Chapter 1\tIntro\nz", "<head><title>t</title></head><body>b</body>": "b",
    "<script>if (a</p>b) {}</script>x<style>p{}</style>y": "xy", "a &amp;amp; b &lt;i&gt;": "a &amp; b <i>", "<!-- c -->x<!-- <p> -->y": "xy", "a <i>b</i> c": "a b c", "": "", "  ": "  ", "<dl><dt>t</dt><dd>d</dd></dl>": "t\nd",
}


def test_html(spark):
    assert {h: M.html_text(h) for h in CASES} == CASES
    rows = spark.createDataFrame([(h,) for h in CASES], "h string").select("h", M.html_to_text_native(F.col("h")).alias("n"), M.html_to_text(F.col("h")).alias("u")).collect()
    assert {r["h"]: r["n"] for r in rows} == CASES
    assert {r["h"]: r["u"] for r in rows} == CASES


def test_html_mended():
    assert M.html_text("<head><title>never closed <p>x") == ""
    assert M.html_text("<p>Caf&eacute; &hellip; &#233;</p>tail <") == "Café … é\ntail <"


def test_html_closed_references(spark):
    page = "<p>a &amp;&amp</p>&lt b &notit; &eacute;&#233;&#xe9; &amp;amp; &none;"
    assert M.html_text(page) == "a &&\n< b ¬it; ééé &amp; &none;"
    closed = "a &&amp\n&lt b &notit; ééé &amp; &none;"
    assert M.html_text(page, closed=True) == closed
    assert spark.createDataFrame([(page,)], "h string").select(M.html_to_text(F.col("h"), closed=True)).first()[0] == closed


def test_rtf():
    raw = r"{\rtf1\ansi{\fonttbl{\f0\fnil Calibri;}}{\colortbl;\red255;}{\stylesheet{\s0 Normal;}}{\*\generator Riched;}{\info{\title T}{\author A}}\f0 Chapter 1\par caf\u233?\'e9 \{x\} a\\b\tab c\par}"
    text = M.rtf_text(raw)
    assert text.split("\n")[0] == "Chapter 1"
    assert not any(x in text for x in ("Calibri", "Normal", "Riched", "T\n", "red255"))
    assert "café" in text and "{x}" in text and "a\\b" in text and "\t" in text
    assert M.rtf_text(r"{\fonttbl never closed") == "never closed"
    assert M.rtf_text(r"\partightenfactor0 x") == "\ntightenfactor0 x"
    assert M.rtf_text("\\u-3913 \\u0 \\u" + "55357 z") == chr(65536 - 3913) + "z"
