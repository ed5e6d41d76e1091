"""Checks of a skill file's frontmatter under the rules of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import WS

# Per host its tools, the keys it knows, words a name must not hold, its shell tools, and whether a list without any known tool is an error.
_BUILT_IN = ["Bash", "Read", "Write", "Edit", "Glob", "Grep", "WebFetch", "WebSearch", "NotebookEdit", "Task", "TodoWrite"]
_KEYS = ["name", "description", "allowed-tools", "license"]
LENSES = {
    "claude": (_BUILT_IN, _KEYS, ["anthropic", "claude"], ["Bash"], True),
    "copilot": (["shell", "bash", "write"], _KEYS, [], ["shell", "bash"], False),
    "amp": ([*_BUILT_IN, "shell_command"], [*_KEYS, "compatibility", "argument-hint"], [], ["shell_command", "Bash"], False),
}
LONGEST_NAME, LONGEST_DESCRIPTION, LONGEST_BODY = 64, 1024, 500


def frontmatter(text: Column) -> Column:
    """What stands between ``---`` at the very start and the next line that begins so; null without either."""
    end = F.instr(F.substring(text, 4, 1 << 30), "\n---")
    return F.when(text.startswith("---") & (end > 0), F.ltrim(F.substring(text, 4, 1 << 30).substr(F.lit(1), end - 1), F.lit("\n")))


def body(text: Column) -> Column:
    rest = F.substring(text, 4, 1 << 30)
    end = F.instr(rest, "\n---")
    return F.when(text.startswith("---") & (end > 0), rest.substr(end + 4, F.length(rest)))


def scalar(fm: Column, key: str) -> Column:
    """Value of a key, white space and then quotes taken off; null without the key."""
    pattern = rf"(?dmU)^{key}:{WS}*(.*)$"
    return F.when(fm.rlike(pattern), F.trim(F.trim(T.strip(F.regexp_extract(fm, pattern, 1)), F.lit('"')), F.lit("'")))


def list_items(fm: Column, key: str) -> Column:
    """Items of the block list under a key, up to the next key."""
    start = F.struct(F.lit(0).alias("on"), F.array().cast("array<string>").alias("items"))

    def step(s: Column, line: Column) -> Column:
        item = T.strip(F.regexp_extract(line, rf"(?U)^{WS}*-{WS}*(.+)$", 1))
        is_item = line.rlike(rf"(?U)^{WS}*-{WS}*.+$")
        return (
            F.when((s["on"] != 2) & line.rlike(rf"(?U)^{key}:{WS}*$"), F.struct(F.lit(1).alias("on"), s["items"].alias("items")))
            .when((s["on"] == 1) & is_item, F.struct(F.lit(1).alias("on"), F.concat(s["items"], F.array(item)).alias("items")))
            .when((s["on"] == 1) & line.rlike(r"^[A-Za-z][\p{L}\p{N}_-]*:"), F.struct(F.lit(2).alias("on"), s["items"].alias("items")))
            .otherwise(s)
        )

    return F.aggregate(T.lines(fm), start, step, lambda s: s["items"])


def keys(fm: Column) -> Column:
    found = F.transform(T.lines(fm), lambda line: F.regexp_extract(line, r"^([A-Za-z][\p{L}\p{N}_-]*):", 1))
    return F.filter(found, lambda k: k != "")


def audit(files: DataFrame, lens: str, key: str = "path", text: str = "text", length: bool = True) -> DataFrame:
    """``(key, lens, severity, rule)`` for every fault of every file; a file without faults has no row.

    Without ``length`` faults of the frontmatter and of the tools it grants alone, not that a file has too many lines.
    """
    tools, known_keys, reserved, shells, strict = LENSES[lens]
    t = F.col(text)
    rows = files.select(key, frontmatter(t).alias("fm"), body(t).alias("body"), F.size(T.lines(t)).alias("n"))
    fm = F.col("fm")
    rows = rows.select("*", scalar(fm, "name").alias("name"), scalar(fm, "description").alias("description"), list_items(fm, "allowed-tools").alias("listed"), scalar(fm, "allowed-tools").alias("inline"), keys(fm).alias("keys"))
    words = F.filter(F.split("inline", rf"(?U){WS}+"), lambda w: w != "")
    rows = rows.withColumn("granted", F.when(F.size("listed") > 0, F.col("listed")).otherwise(F.coalesce(words, F.array().cast("array<string>"))))
    rows = rows.withColumn("bases", F.array_distinct(F.transform("granted", lambda g: T.strip(F.element_at(F.split(g, r"\("), 1)))))
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    none = lambda c: F.col(c).isNull() | (F.col(c) == "")
    some = F.size("granted") > 0
    known = F.array_intersect("bases", lit(tools))
    fault = lambda hit, severity, rule: F.when(hit, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule")))
    shell = F.col("body").contains("```bash") | F.col("body").contains("python3 ")
    holds = F.lit(False)
    for w in reserved:
        holds = holds | F.lower("name").contains(w)
    faults = F.array(
        fault(none("name"), "error", "name.missing"),
        fault(F.length("name") > LONGEST_NAME, "error", "name.long"),
        fault(~none("name") & ~F.col("name").rlike(r"^[a-z0-9-]+\z"), "error", "name.characters"),
        fault(~none("name") & holds, "error", "name.reserved"),
        fault(none("description"), "error", "description.missing"),
        fault(F.length("description") > LONGEST_DESCRIPTION, "error", "description.long"),
        fault(some & shell & (F.size(F.array_intersect("bases", lit(shells))) == 0), "error", "tools.shell_blocked"),
        fault(some & (F.size(known) == 0), "error", "tools.none_known") if strict else fault(F.lit(False), "error", "tools.none_known"),
        fault(some & (F.size(F.array_except("bases", lit(tools))) > 0), "warn", "tools.unknown"),
        *([fault(F.col("n") > LONGEST_BODY, "warn", "body.long")] if length else []),
    )
    unknown_keys = F.transform(F.filter("keys", lambda k: ~k.isin(*known_keys)), lambda k: F.struct(F.lit("warn").alias("severity"), F.concat(F.lit("key.unknown:"), k).alias("rule")))
    missing = F.array(F.struct(F.lit("error").alias("severity"), F.lit("frontmatter.missing").alias("rule")))
    every = F.when(fm.isNull(), missing).otherwise(F.concat(F.array_compact(faults), unknown_keys))
    return rows.select(key, F.lit(lens).alias("lens"), F.explode(every).alias("f")).select(key, "lens", "f.severity", "f.rule")
