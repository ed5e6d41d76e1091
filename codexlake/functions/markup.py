"""HTML and RTF to text: scanners over one document, and Arrow-batched Column functions around them."""

from __future__ import annotations

import html
import html.entities
import re
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without text, elements that end a line, cells that end with a tab.
SKIP = frozenset({"script", "style", "head"})
BLOCK = frozenset(
    "address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table tbody tfoot thead tr ul".split()
)
CELL = frozenset({"td", "th"})
_TAG = re.compile(r"<!--.*?--\s*>|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)


#: Character references with their semicolon, as well-formed pages write them.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([a-zA-Z][a-zA-Z0-9]*));")


def _unescape_closed(data: str) -> str:
    """Only whole references: neither ``&amp`` at the end of a text that was cut, nor a name that merely begins like one."""
    return _CLOSED.sub(lambda m: m[0] if m[1] and f"{m[1]};" not in html.entities.html5 else html.unescape(m[0]), data)


def html_text(page: str, closed: bool = False) -> str:
    """Text of a page: blocks on lines of their own, cells of a row on one line, white space inside kept.

    A separator waits until text that is not blank follows; blank text after a waiting separator goes,
    and so does a separator at either end.  An incomplete last tag and what follows it is left out.
    Character references are read as browsers do, with ``closed`` only those with a semicolon.
    """
    unescape = _unescape_closed if closed else html.unescape
    out: list[str] = []
    waiting, depth, at = "", 0, 0
    while at <= len(page):
        m = _TAG.search(page, at)
        data = page[at : m.start() if m else len(page)]
        if not m:
            data = re.sub(r"<[a-zA-Z/!?].*", "", data, flags=re.S)
        if data and not depth:
            data = unescape(data)
            if data.strip() or not waiting:
                if waiting and out:
                    out.append(waiting)
                waiting = "" if data.strip() else waiting
                out.append(data)
        if not m:
            break
        at = m.end()
        name, closing = (m.group(2) or "").lower(), bool(m.group(1))
        if name in SKIP:
            depth = max(0, depth - 1) if closing else depth + 1
            if name != "head" and not closing:  # raw content ends at its own closing tag alone
                end = re.compile(rf"</{name}\s*(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
        elif name in BLOCK:
            waiting = "\n"
        elif name in CELL:
            waiting = waiting or "\t"
    return "".join(out)


# RTF destinations that hold no text of the document.
RTF_SKIPPED = frozenset(
    """fonttbl colortbl stylesheet info listtable listoverridetable revtbl rsidtbl latentstyles datastore themedata colorschememapping
    filetbl xmlnstbl pgptbl protusertbl userprops docvar pict objdata bkmkstart bkmkend""".split()
)
#: What stands at a place of an RTF file.  A backslash before one that starts a code, a line or a tab is plain.
_RTF_TOKEN = re.compile(
    r"""\\u(?P<code>-?\d+)[ ]?(?:\\'[0-9a-fA-F]{2}|\?)?
      | (?P<byte>\\'[0-9a-fA-F]{2})
      | \\(?P<line>pard?)
      | (?P<tab>\\tab)
      | (?P<stray>\\(?=\\(?:u-?\d|'[0-9a-fA-F]{2}|par|tab)))
      | \\(?P<mark>[\\{}])
      | \\(?P<word>[a-zA-Z]+)-?\d*(?:[ ]|\\'[0-9a-fA-F]{2})?
      | \{(?P<open>(?:\\\*|\\[a-zA-Z]+)?)
      | (?P<close>\})
      | (?P<text>[^\\{}]+|\\)""",
    re.X | re.S,
)


class _Rtf:
    """One pass over an RTF file with a stack of its groups; each knows whether its text is shown."""

    def __init__(self, raw: str, hiding: bool) -> None:
        self.out: list[str] = []
        self.shown = [True]
        at = 0
        while at < len(raw):
            m = _RTF_TOKEN.match(raw, at)
            at = m.end()
            if m.lastgroup == "open":
                start = m.group("open")
                self.shown.append(self.shown[-1] and not (hiding and (start == "\\*" or start[1:] in RTF_SKIPPED)))
                at = m.start("open")  # the word is a token of its own
            elif m.lastgroup == "close":
                if len(self.shown) > 1:
                    self.shown.pop()
            elif self.shown[-1]:
                self.out.append(self._plain(m))

    @staticmethod
    def _plain(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "code":
            n = int(m["code"]) % 65536
            return "" if n == 0 or 0xD800 <= n < 0xE000 else chr(n)
        if kind in ("mark", "text"):
            return m[kind]
        return {"byte": " ", "line": "\n", "tab": "\t", "stray": "\\"}.get(kind, "")


def rtf_text(raw: str) -> str:
    """Text of an RTF file; a group that hides its text and never ends hides nothing in the whole file.

    ``\\par`` and ``\\tab`` are read wherever these letters stand; other control words go with their number and one
    blank, which a byte's code right after them, read as a blank, is too.  A hidden group parts what stands around it.
    """
    read = _Rtf(raw, hiding=True)
    if not read.shown[-1]:
        read = _Rtf(raw, hiding=False)
    return html.unescape("".join(read.out))


def _mapped(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def html_to_text(page: Column, closed: bool = False) -> Column:
    return _mapped(partial(html_text, closed=closed))(page)


def rtf_to_text(raw: Column) -> Column:
    return _mapped(rtf_text)(raw)


#: Steps of the same reading of well-formed pages without cells and with the entities below, inside the JVM.
_ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&#39;": "'", "&amp;": "&"}


def html_to_text_native(page: Column) -> Column:
    """As ``html_to_text`` for well-formed pages; no Python."""
    names = "|".join(sorted(BLOCK, key=len, reverse=True))
    x = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "\x04")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->|<![^>]*>", "\x04")
    x = F.regexp_replace(x, r"(?is)<head\b[^>]*>.*?</head\s*>", "\x04")
    x = F.regexp_replace(x, rf"(?i)</?(?:{names})(?=[\s/>])[^>]*>", "\x02")
    x = F.regexp_replace(x, r"(?i)</?t[dh](?=[\s/>])[^>]*>", "\x03")
    x = F.regexp_replace(x, r"</?[a-zA-Z][^>]*>", "\x04")
    for name, char in _ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    # a run of separators is one, and a line break outranks a tab; blanks within it go, those before it stay
    x = F.regexp_replace(x, r"(?U)(?:\x03(?:[\s\x04]*[\x03\x04])*[\s\x04]*)?\x02(?:[\s\x04]*[\x02\x03\x04])*", "\x02")
    x = F.regexp_replace(x, r"(?U)\x03(?:[\s\x04]*[\x03\x04])*", "\x03")
    x = F.regexp_replace(x, r"^\x04*[\x02\x03]|[\x02\x03]\x04*\z", "")
    return F.translate(x, "\x02\x03\x04", "\n\t")
