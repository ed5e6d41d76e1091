"""Findings of unsafe content in generated Markdown bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import WORD_END, WS

WORD_START = r"(?<![\p{L}\p{N}_])"

# Rule names, what they match, and their messages.
RULES: dict[str, tuple[str, str]] = {
    "prompt.ignore_previous": (rf"(?iu){WORD_START}ignore{WS}+(?:(?:all|any|the){WS}+)?(?:previous|prior){WS}+(?:instructions?|prompts?|rules?|messages?){WORD_END}", "contains an instruction-override phrase"),
    "prompt.disregard_system": (rf"(?iu){WORD_START}disregard{WS}+(?:the{WS}+)?(?:system|developer){WORD_END}", "contains a system-instruction override phrase"),
    "prompt.role_reassignment": (rf"(?iu){WORD_START}you{WS}+are{WS}+now{WORD_END}", "contains a role-reassignment phrase"),
    "prompt.fake_system_prefix": (rf"(?iu)^{WS}*(?:[-*]{WS}*)?(?:system|developer){WS}*:", "contains a system-like message prefix"),
    "prompt.system_tag": (rf"(?iu)<{WS}*/?{WS}*system{WORD_END}[^>]*>", "contains a system-message tag"),
    "prompt.chat_template_tag": (rf"(?iu)<\|{WS}*im_start{WS}*\|>|\[{WS}*INST{WS}*\]", "contains a model chat-template delimiter"),
    "prompt.tool_call_tag": (
        rf'(?iu)<\|?{WS}*/?{WS}*tool[_ -]?call{WS}*\|?>|\[{WS}*/?{WS}*tool[_ -]?call{WS}*\]|\{{\{{{WS}*/?{WS}*tool[_ -]?call{WS}*\}}\}}|"{WS}*tool[_ -]?call{WS}*"',
        "contains a tool-call control token",
    ),
}
EXFILTRATE = rf"(?iu){WORD_START}exfiltrat(?:e|es|ed|ing|ion){WORD_END}"
OUTBOUND = rf"(?iu){WORD_START}(?:curl|wget|send|post|upload|transmit){WORD_END}|https?://"
SENSITIVE = rf"(?iu)\.env{WORD_END}|{WORD_START}base64{WORD_END}|{WORD_START}secrets?{WORD_END}|{WORD_START}credentials?{WORD_END}|{WORD_START}api[_ -]?keys?{WORD_END}"
TOOLS = rf"(?iu)^{WS}*allowed-tools{WS}*:"
INVOKED = rf"(?iu)^{WS}*disable-model-invocation{WS}*:{WS}*[\"']?(?:false|no|0)[\"']?{WS}*(?:#.*)?$"
MAX_FILES, MAX_BYTES, MAX_TOTAL = 1000, 2 * 1024 * 1024, 20 * 1024 * 1024
ENTRY_FILE = "SKILL.md"
SUPPORT_FILES = ("glossary.md", "patterns.md", "cheatsheet.md")


#: A text or line without any of these in lower case, without a character that folds to ASCII and without an invisible one has no finding.
_NEEDLES = ("ignore", "disregard", "you", "system", "developer", "im_start", "[", "tool", "exfiltrat", "curl", "wget", "send", "post", "upload", "transmit", "http", "disable-model")
_FOLDS = "ſıİ\u212a"


def _maybe(text: Column) -> Column:
    """Plain searches for each needle, which are far cheaper than one expression with all of them."""
    found = T.let(F.lower(text), lambda low: reduce(lambda a, b: a | b, (low.contains(n) for n in _NEEDLES)))
    odd = reduce(lambda a, b: a | b, (text.contains(c) for c in _FOLDS)) | text.rlike(T.INVISIBLE_CLASS)
    return found | ((F.octet_length(text) != F.length(text)) & odd)


def in_scope(path: Column) -> Column:
    """The entry file, the support files, and Markdown anywhere under chapters."""
    return path.isin(ENTRY_FILE, *SUPPORT_FILES) | path.rlike(r"^chapters/(?:.*/)?[^/]*\.md$")


def findings(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``(key, line, rule_id, message)`` of every line of ``files``; one finding a rule and line."""
    ls = T.lines(F.col(text))
    # frontmatter is known from the text alone: from a first line --- to the next such line
    end = F.array_position(F.transform(F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0))), T.strip), "---")
    docs = files.where(_maybe(F.col(text))).select(key, ls.alias("ls")).where(F.size("ls") > 0)
    docs = docs.select(key, "ls", F.when(T.strip(F.element_at("ls", 1)) == "---", end).otherwise(0).alias("z"))
    lines = docs.select(key, "z", F.posexplode("ls").alias("line_no", "raw")).withColumn("line", F.col("line_no") + 1)
    front = (F.col("line_no") > 0) & (F.col("line_no") < F.col("z"))
    lines = lines.where(_maybe(F.col("raw")))
    rule = lambda hit, name, message: F.when(hit, F.struct(F.lit(name).alias("rule_id"), message.alias("message")))
    raw = F.col("raw")
    points = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("raw", F.lit(f"({T.INVISIBLE_CLASS})"), 1), lambda c: F.ascii(c))))
    shown = F.array_join(F.transform(points, lambda n: F.concat(F.lit("U+"), F.lpad(F.hex(n), F.greatest(F.lit(4), F.length(F.hex(n))), F.lit("0")))), ", ")
    hits = F.array_compact(
        F.array(
            rule(raw.rlike(T.INVISIBLE_CLASS), "unicode.invisible", F.concat(F.lit("contains invisible Unicode code point(s): "), shown)),
            *(rule(raw.rlike(p), name, F.lit(m)) for name, (p, m) in RULES.items()),
            rule(raw.rlike(EXFILTRATE) | (raw.rlike(OUTBOUND) & raw.rlike(SENSITIVE)), "tool.exfiltration_shape", F.lit("contains exfiltration-shaped tool or sensitive-data language")),
            rule(front & raw.rlike(TOOLS), "frontmatter.allowed_tools", F.lit("generated frontmatter declares or widens tool authority")),
            rule(front & raw.rlike(INVOKED), "frontmatter.model_invocation_enabled", F.lit("generated frontmatter explicitly enables model invocation")),
        )
    )
    return lines.select(key, "line", F.explode(hits).alias("f")).select(key, "line", "f.rule_id", "f.message")


def scan_bundle(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings in order, Markdown files out of scope, and one status row of ``files(path, text)``.

    Status: 2 when a limit on files or bytes is passed, the entry file is missing, or a file in scope could not be
    read (its text is null: no valid UTF-8, or a link that the reader refused); else 1 with findings; else 0.
    """
    scoped = files.where(in_scope(F.col("path")))
    found = findings(scoped)
    skipped = files.where(F.lower("path").endswith(".md")).join(scoped.select("path"), "path", "left_anti").select("path")
    size = F.octet_length("text")
    limits = scoped.agg(F.count("*").alias("n"), F.max(size).alias("most"), F.sum(size).alias("total"), F.count(F.when(F.col("path") == ENTRY_FILE, 1)).alias("entry"), F.count(F.when(F.col("text").isNull(), 1)).alias("unread"))
    broken = (F.col("n") > MAX_FILES) | (F.col("most") > MAX_BYTES) | (F.col("total") > MAX_TOTAL) | (F.col("entry") == 0) | (F.col("unread") > 0)
    status = limits.join(found.agg(F.count("*").alias("findings")), F.lit(True))
    status = status.select(F.when(F.coalesce(broken, F.lit(True)), 2).when(F.col("findings") > 0, 1).otherwise(0).alias("status"), F.col("n").alias("files"), "unread", "findings")
    return found.orderBy(F.lower("path"), "line", "rule_id"), skipped, status
