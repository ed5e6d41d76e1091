from pyspark.sql import functions as F

from codexlake.functions import text as T
from codexlake.sources.encoding import decode_text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_lines_as_python_splits_them(spark):
    for text in ["", "a", "a\n", "a\r\nb\rc\n\nd", "a\x0bb\x0cc\x1cd\x85e f g", "\n\n"]:
        assert one(spark, text, T.lines) == text.splitlines()


def test_strip_and_words_are_unicode(spark):
    for text in ["  a b ", " x　y\x1f", "\t\n", "plain", "a b"]:
        assert one(spark, text, T.strip) == text.strip()
        assert one(spark, text, T.word_count) == len(text.split())


def test_token_estimates(spark):
    assert one(spark, "word " * 100, T.estimate_tokens) == 133
    assert one(spark, "中" * 1500, T.estimate_tokens) == 1000
    assert one(spark, "word " * 100 + "\U00020000", T.estimate_tokens) == 134
    assert one(spark, "\U000323af" * 300, T.estimate_tokens) == 200
    assert one(spark, "", T.estimate_tokens) == 0
    assert one(spark, "中" * 3, T.word_tokens) == 1


def test_invisible_characters_go(spark):
    text = "a​b‮c\U000e0041d­ﾠمرحبا"
    assert one(spark, text, T.sanitize) == "abcdمرحبا"
    assert one(spark, text, T.invisible_count) == 5


def test_hyphens(spark):
    assert one(spark, "informa-\ntion a-\nb-\nc", T.rejoin_hyphens) == "information ab-\nc"


def test_terminal_safe(spark):
    text = "a\\b\té中\U0001f600\x7f"
    assert one(spark, text, T.terminal_safe) == text.encode("unicode_escape").decode("ascii")


def test_decoding(spark):
    cases = {
        b"plain": "plain", "é€".encode(): "é€", "é€".encode("utf-8-sig"): "é€", "é\U0001f600".encode("utf-16"): "é\U0001f600", b"\xfe\xff" + "é".encode("utf-16-be"): "é",
        "é\U0001f600a".encode("utf-32"): "é\U0001f600a", "“x”".encode("cp1252"): "“x”", b"\x81\xe9": "\x81é", b"": "",
    }
    for raw, text in cases.items():
        assert one(spark, bytearray(raw), decode_text, "binary") == text, raw


def test_ratio_and_banner(spark):
    row = spark.createDataFrame([(7, 2, 0)], "a int, b int, z int").select(T.ratio(F.col("a"), F.col("b")), T.ratio(F.col("a"), F.col("z"))).first()
    assert list(row) == ["3.5x", "n/a"]
    banner = spark.createDataFrame([("f", "/p")], "f string, p string").select(T.source_banner(F.col("f"), F.col("p"))).first()[0]
    assert banner == "\n\n" + "=" * 80 + "\nSOURCE: f (Path: /p)\n" + "=" * 80 + "\n\n"


def test_ratio_rounds_as_the_quotient_is(spark):
    # 0.15 and 0.35 lie below their decimals, 0.45 above; 0.25 and 0.75 are ties
    pairs = [(a, 5000) for a in (750, 1250, 1750, 2250, 3750, 274849)] + [(123456789, 10)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", T.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert {(x["a"], x["b"]): x["r"] for x in rows} == {(a, b): f"{a / b:.1f}x" for a, b in pairs}
