"""Leaf blocks of an HTML page with their tag paths, and the numpy network that labels them."""

from __future__ import annotations

import html
import math
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never rendered as text.
SILENT = frozenset("script style template noscript head title svg iframe object audio video canvas datalist textarea select option button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Formulas stand in a line of text; annotations repeat them in another notation and are not rendered.
INLINE |= frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split())
UNSEEN = frozenset("annotation annotation-xml".split())
#: What may stand in a head; anything else, text too, ends a head that is still open.
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template head html".split())
#: Elements that an opening tag ends when they are still open.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Block elements that end an open paragraph.
_BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

#: Comments, declarations and tags, as browsers end them: a quote opens a value only right after "=", and one that is never closed runs to the end.
_MARK = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # element names and the words of their class, id and role, outermost first
    linked: int  # characters inside links
    depth: int = 0


@dataclass
class _Open:
    name: str
    words: tuple[str, ...] = field(default_factory=tuple)


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: runs of text between block elements, white space made single.

    Unclosed and misnested tags are mended as browsers do for paragraphs, list items and cells; an
    unknown closing tag is passed over.  Silent elements give no text.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[_Open] = []
    parts: list[str] = []
    linked = silent = 0
    link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                path = tuple(w for e in stack for w in (e.name, *e.words))
                out.append(Block(text, path, linked, len(stack)))
        linked = 0

    def close(to: int) -> None:
        nonlocal silent, link
        for e in stack[to:]:
            silent -= e.name in SILENT
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        end = m.start() if m else n
        if end > at and stack and stack[-1].name == "head" and not page[at:end].isspace():
            close(len(stack) - 1)
        if end > at and not silent:
            parts.append(page[at:end])
            if link:
                linked += end - at
        if not m:
            break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):  # a closing tag
            if name == "a":
                link = max(0, link - 1)
            if name in INLINE and name not in SILENT:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    flush()
                    close(k)
                    break
            continue
        if stack and stack[-1].name == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        if name == "head" and any(e.name != "html" for e in stack):  # passed over inside a head or a body
            continue
        if name in UNSEEN:
            tail = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = tail.end() if tail else at
            continue
        if name == "a":
            link += 1
        if name in INLINE:
            if name in ("br", "img", "input", "wbr"):
                parts.append(" " if name == "br" else "")
            continue
        flush()
        link = 0
        if name in VOID:
            continue
        ends = ENDS.get(name, {"p"} if name in _BREAKS_P else ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in ends:
                close(k)
                break
            if stack[k].name not in ("p", "li", "td", "th", "dt", "dd"):
                break
        if m.group(3).rstrip().endswith("/") and name in SILENT:
            continue
        if name in RAW:  # its content has no markup
            tail = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = tail.end() if tail else n
            continue
        words = tuple(w for a in _NAMED.finditer(m.group(3)) for w in _WORD.findall((a.group(2) or a.group(3) or a.group(4) or "").lower()))
        stack.append(_Open(name, words))
        silent += name in SILENT
    flush()
    return out


#: Hashed inputs: of the path's names and words, of the block's own element, of the text's words; then plain numbers.
PATH, LAST, TEXT, PLAIN, HIDDEN = 96, 24, 96, 8, 16
INPUTS = PATH + LAST + TEXT + PLAIN


def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % size, 1.0 if (h >> 20) & 1 else -1.0


@lru_cache(maxsize=1 << 14)
def _path(path: tuple[str, ...]) -> np.ndarray:
    x = np.zeros(PATH + LAST, np.float32)
    for w in set(path):
        i, s = _slot(w, PATH)
        x[i] += s
    i, s = _slot(path[-1] if path else "", LAST)
    x[PATH + i] += s
    return x


def spoken(page: list[Block]) -> np.ndarray:
    """Of each block the hashed vector of all its words, of length 0.8 however many they are."""
    words = [_SPOKEN.findall(b.text.lower().encode()) for b in page]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.uint32, int(n.sum()))
    sign = np.where((h >> np.uint32(20)) & np.uint32(1), 1.0, -1.0)
    at = np.repeat(np.arange(len(page)), n) * TEXT + h % np.uint32(TEXT)
    out = np.bincount(at, weights=sign, minlength=len(page) * TEXT).reshape(-1, TEXT)
    return out * (0.8 / np.maximum(np.sqrt((out * out).sum(axis=1)), 1))[:, None]


def inputs(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), INPUTS), np.float32)
    plain = []
    for k, b in enumerate(page):
        x[k, : PATH + LAST] = _path(b.path)
        size, gaps, count = len(b.text), b.text.count(" "), b.text.count
        plain.append(
            (math.log1p(size) / 6, min(1.0, b.linked / size), (count(".") + count(",") + count("!") + count("?")) / (2 + gaps), k / len(page), 1.0, b.depth / 10, float(b.text[-1] in ".!?"), math.log1p(len(page)) / 4)
        )
    x[:, PATH + LAST : PATH + LAST + TEXT] = spoken(page)
    x[:, PATH + LAST + TEXT :] = plain
    return x


class Labeller:
    """A bidirectional LSTM over a page's blocks; the output is the log odds of main text."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["w" + d] = (rng.standard_normal((INPUTS, 4 * h)) * 0.15).astype(np.float32)
            self.p["u" + d] = (rng.standard_normal((h, 4 * h)) * 0.2).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.p["c" + d] = bias
        self.p["o"] = (rng.standard_normal((2 * h + INPUTS, 1)) * 0.1).astype(np.float32)
        self.p["q"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states ``(pages, steps, HIDDEN)`` in the order of ``x``, and what the gradient needs."""
        n, steps, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((n, steps, HIDDEN), np.float32), []
        pre = x @ self.p["w" + d] + self.p["c" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p["u" + d]
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = f * c + i * g
            kept.append((t, h, c, i, f, o, g, np.tanh(new), m))
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[:, t] = h
        return out, kept

    def odds(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0], x], axis=2)
        return (both @ self.p["o"])[:, :, 0] + self.p["q"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0], x], axis=2)
        z = (both @ self.p["o"])[:, :, 0] + self.p["q"]
        slope = ((1 / (1 + np.exp(-z)) - y) * mask / mask.sum()).astype(np.float32)[:, :, None]
        g = {"o": np.einsum("nth,ntk->hk", both, slope), "q": slope.sum((0, 1))}
        back = slope @ self.p["o"].T
        for k, d in enumerate("fb"):
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            gw, gu, gc = (np.zeros_like(self.p[n + d]) for n in "wuc")
            for t, h, c, i, f, o, cell, tanh, m in reversed(runs[d][1]):
                dh = dh + back[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                new = dc + dh * o * (1 - tanh * tanh)
                dz = np.concatenate([new * cell * i * (1 - i), new * c * f * (1 - f), dh * tanh * o * (1 - o), new * i * (1 - cell * cell)], axis=1) * m
                gw += x[:, t].T @ dz
                gu += h.T @ dz
                gc += dz.sum(axis=0)
                dh, dc = np.where(m, dz @ self.p["u" + d].T, dh), np.where(m, new * f, dc)
            g |= {"w" + d: gw, "u" + d: gu, "c" + d: gc}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 24, batch: int = 48, rate: float = 0.012) -> None:
        """Adam over pages of similar length together."""
        rng = np.random.default_rng(3)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        first, second = ({n: np.zeros_like(a) for n, a in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(rounds):
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[j][0] for j in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for r, j in enumerate(groups[k]):
                    y[r, : len(pages[j][1])] = pages[j][1]
                t += 1
                step = rate * (1 - 0.95 * t / (rounds * len(groups)))
                for n, g in self.gradient(x, mask, y).items():
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.01 * (g * g - second[n])
                    self.p[n] -= step * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.99**t)) + 1e-8)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, INPUTS), np.float32), np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask
