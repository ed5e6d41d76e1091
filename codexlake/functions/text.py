"""Text primitives as Column expressions: lines, stripping, word and token counts, invisible characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, letters-digits-underscore and the end of a word, as the engine defines them for every language.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{SPACES}]"
WORD = r"[\p{L}\p{N}_]"
WORD_END = r"(?![\p{L}\p{N}_])"
#: Ends of lines: CR LF as one, then every single character that ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# Code points that show nothing, and the block of tag characters.
INVISIBLE = (
    0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x034F, 0x180E, 0x2061, 0x2062, 0x2063, 0x2064,
    0x200E, 0x200F, 0x061C, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069,
    0x115F, 0x1160, 0x3164, 0xFFA0,
)
TAGS = range(0xE0000, 0xE0080)
INVISIBLE_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in INVISIBLE) + f"\\x{{{TAGS[0]:X}}}-\\x{{{TAGS[-1]:X}}}]"
_INVISIBLE_CHARS = "".join(map(chr, (*INVISIBLE, *TAGS)))

# Characters of scripts without spaces, words to a token, such characters to a token.
CJK = r"[\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}]"
WORDS_PER_TOKEN = 0.75
CJK_PER_TOKEN = 1.5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, even if ``use`` has it in functions over arrays."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column) -> Column:
    """Array of the text's lines; an end of line at the end of the text begins no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACES}]")


#: Runs of white space, and single characters of it other than a blank.
_GAPS = f"[{SPACES}]{{2,}}|[{SPACES.replace('x20', 'x1f')}]"


def word_count(text: Column) -> Column:
    """Gaps between words, and one: gaps are made single blanks first, and a blank doubled tells how many there are.

    No array of the words is made, which takes several times as long.
    """
    return _blanks(_single(text))


def _single(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _GAPS, " "))


def _blanks(one: Column) -> Column:
    return (F.length(F.replace(one, F.lit(" "), F.lit("  "))) - F.length(one) + (one != "").cast("int")).cast("long")


def word_count_in_array(text: Column) -> Column:
    """``word_count`` within functions over arrays, where nothing else keeps the shared step from being done again."""
    return let(_single(text), _blanks)


def cjk_count(text: Column) -> Column:
    """Pure ASCII, as many bytes as characters, is never searched."""
    return F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit(CJK))).cast("long")


def estimate_tokens(text: Column) -> Column:
    """Words at WORDS_PER_TOKEN and CJK characters at CJK_PER_TOKEN, with one floor at the end."""
    cjk = cjk_count(text)
    mixed = F.floor(word_count(F.regexp_replace(text, CJK, " ")) / F.lit(WORDS_PER_TOKEN) + cjk / F.lit(CJK_PER_TOKEN))
    return F.when(cjk == 0, word_tokens(text)).otherwise(mixed).cast("long")


def word_tokens(text: Column, in_array: bool = False) -> Column:
    """Tokens by words alone, whatever the script."""
    return F.floor((word_count_in_array if in_array else word_count)(text) / F.lit(WORDS_PER_TOKEN)).cast("long")


def sanitize(text: Column) -> Column:
    return F.translate(text, _INVISIBLE_CHARS, "")


def invisible_count(text: Column) -> Column:
    return (F.length(text) - F.length(sanitize(text))).cast("long")


def rejoin_hyphens(text: Column) -> Column:
    """A word broken by a hyphen at the end of a line is made whole."""
    return F.regexp_replace(text, rf"({WORD})-\n({WORD})", "$1$2")


def human_tokens(tokens: Column) -> Column:
    return F.concat(F.lit("~"), F.floor(tokens / 1000).cast("string"), F.lit("K"))


def size_mb(n_bytes: Column) -> Column:
    return F.bround(n_bytes / F.lit(1048576.0), 2)


def ratio(a: Column, b: Column) -> Column:
    """To one decimal by the exact value of the quotient, ties to even; ``format_string`` rounds its shortest decimal up."""
    return F.when(b != 0, F.concat(F.call_function("format_number", a / b, F.lit("0.0")), F.lit("x"))).otherwise("n/a")


def source_banner(filename: Column, path: Column) -> Column:
    rule = F.repeat(F.lit("="), 80)
    return F.concat(F.lit("\n\n"), rule, F.lit("\nSOURCE: "), filename, F.lit(" (Path: "), path, F.lit(")\n"), rule, F.lit("\n\n"))


def terminal_safe(text: Column) -> Column:
    """ASCII only: other characters and controls as escapes.  A JVM fold over characters."""
    code = lambda c: F.ascii(c)
    two = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}

    def shown(c: Column) -> Column:
        out = F.when((code(c) >= 32) & (code(c) < 127) & (c != "\\"), c)
        for k, v in two.items():
            out = out.when(c == k, F.lit(v))
        n = code(c)
        out = out.when(n < 256, F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(n)), 2, "0")))
        out = out.when(n < 65536, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0")))
        return out.otherwise(F.concat(F.lit("\\U"), F.lpad(F.lower(F.hex(n)), 8, "0")))

    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    return F.array_join(F.transform(chars, shown), "")
