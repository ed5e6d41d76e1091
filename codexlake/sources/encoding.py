"""Bytes of text files decoded inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Windows-1252 has in place of the controls 80-9F; five of these bytes it leaves undefined.
_CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž",
    0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
_UNDEFINED = "[" + "".join(f"\\x{b:02X}" for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) + "]"


def _utf32(content: Column, big: bool) -> Column:
    """Groups of four bytes after the mark, as code points: the engine has no such charset."""
    digits = F.hex(F.substring(content, 5, 1 << 30))
    units = F.regexp_extract_all(digits, F.lit("(.{8})"), 1)
    point = (lambda u: u) if big else (lambda u: F.concat(F.substring(u, 7, 2), F.substring(u, 5, 2), F.substring(u, 3, 2), F.substring(u, 1, 2)))
    utf8 = lambda u: F.decode(F.unhex(_utf8_hex(F.conv(point(u), 16, 10).cast("long"))), "UTF-8")
    return F.array_join(F.transform(units, utf8), "")


def _utf8_hex(n: Column) -> Column:
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda k: byte(F.lit(0x80).bitwiseOR(F.shiftright(n, 6 * k).bitwiseAND(0x3F)))
    return (
        F.when(n < 0x80, byte(n))
        .when(n < 0x800, F.concat(byte(F.lit(0xC0).bitwiseOR(F.shiftright(n, 6))), tail(0)))
        .when(n < 0x10000, F.concat(byte(F.lit(0xE0).bitwiseOR(F.shiftright(n, 12))), tail(1), tail(0)))
        .otherwise(F.concat(byte(F.lit(0xF0).bitwiseOR(F.shiftright(n, 18))), tail(2), tail(1), tail(0)))
    )


def decode_text(content: Column) -> Column:
    """A byte order mark decides; else UTF-8 where the bytes are valid, else Windows-1252, else Latin-1."""
    head = F.hex(F.substring(content, 1, 4))
    latin = F.decode(content, "ISO-8859-1")
    western = F.when(latin.rlike(_UNDEFINED), latin).otherwise(F.translate(latin, "".join(map(chr, _CP1252)), "".join(_CP1252.values())))
    plain = F.when(F.is_valid_utf8(F.coalesce(content, F.lit(b"")).cast("string")), content.cast("string")).otherwise(western)
    rest = lambda n: F.substring(content, n + 1, 1 << 30)
    out = F.when(head.startswith("EFBBBF") & F.is_valid_utf8(content.cast("string")), rest(3).cast("string"))
    out = out.when(head == "0000FEFF", _utf32(content, True)).when(head == "FFFE0000", _utf32(content, False))
    even = F.octet_length(content) % 2 == 0
    return out.when(head.startswith("FEFF") & even, F.decode(rest(2), "UTF-16BE")).when(head.startswith("FFFE") & even, F.decode(rest(2), "UTF-16LE")).otherwise(plain)
