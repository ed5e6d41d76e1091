"""Whole-text token ids of a public BPE tokenizer with word ends, memoised by word."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Words and pieces a worker remembers; beyond, it starts anew.
REMEMBER = 1 << 20
_FAR = np.iinfo(np.int32).max
# The scheme of the tokenizer file that the array path below reproduces; other files go to the library alone.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words in which lower-casing and classes of characters are plain, and how the split pattern reads there.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: A single one after letters is a piece of its own.
_MARKS = b".,;:!?"
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordTokenizer:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    White space ends every piece and is dropped, so a text's ids are those of its words in turn, and each
    different word is encoded once a worker.  Words of plain characters are encoded many at a time by
    array operations: every round merges the best pair of each word.  All other words, and those that
    could hold a special token, go to the library.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        steps = told["pre_tokenizer"].get("pretokenizers", [])
        self.fast = bool(
            self.kind == np.dtype("<u2") and told["normalizer"] == _NORMALIZER and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"] and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and model["type"] == "BPE"
            and model["end_of_word_suffix"] == "</w>" and not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
            and all(x["content"].startswith("<|") for x in told["added_tokens"])
        )
        if self.fast:
            self._tables(model)

    def _tables(self, model: dict) -> None:
        vocab = model["vocab"]
        shown = _byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.uint32)
        self.final = np.array([vocab[c + "</w>"] for c in shown], np.uint32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, whole = (np.array(x, np.uint32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        key = (left << np.uint32(16)) | right
        bits = max(16, int(len(key) - 1).bit_length() + 4)
        self.shift = np.uint32(32 - bits)
        self.keys, self.ranks, self.news = np.zeros(1 << bits, np.uint32), np.full(1 << bits, _FAR, np.int32), np.zeros(1 << bits, np.uint32)
        self.probes = 1
        rest = np.arange(len(key))[::-1]  # the first of equal merges is written last
        slot = (key * np.uint32(0x9E3779B1)) >> self.shift
        while len(rest):
            free = self.ranks[slot[rest]] == _FAR
            place = rest[free]
            self.keys[slot[place]], self.ranks[slot[place]], self.news[slot[place]] = key[place], place, whole[place]
            rest = rest[(self.keys[slot[rest]] != key[rest])]
            slot[rest] = (slot[rest] + 1) & np.uint32((1 << bits) - 1)
            self.probes += bool(len(rest))

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = left.shape
        key = ((left << np.uint32(16)) | right).ravel()
        slot = (key * np.uint32(0x9E3779B1)) >> self.shift
        rank = np.where(self.keys[slot] == key, self.ranks[slot], _FAR)
        new = self.news[slot]
        open_ = np.flatnonzero((rank == _FAR) & (self.ranks[slot] != _FAR))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & np.uint32(len(self.keys) - 1)
            s = slot[open_]
            same = self.keys[s] == key[open_]
            rank[open_] = np.where(same, self.ranks[s], _FAR)
            new[open_] = self.news[s]
            open_ = open_[~same & (self.ranks[s] != _FAR)]
        return rank.reshape(shape), new.reshape(shape)

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of equal length: each round merges the leftmost best pair of every piece."""
        n, width = len(pieces), len(pieces[0])
        raw = np.frombuffer(b"".join(pieces), np.uint8).reshape(n, width)
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        done: list[bytes] = [b""] * n
        rows = np.arange(n)
        rank, new = self._look(ids[:, :-1], ids[:, 1:])
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.intp)
            on = rank[np.arange(len(rows)), best] != _FAR if rank.shape[1] else np.zeros(len(rows), bool)
            if not on.all():
                for r, x in zip(rows[~on].tolist(), ids[~on].astype(self.kind), strict=True):
                    done[r] = x.tobytes()
                rows, ids, rank, new, best = rows[on], ids[on], rank[on], new[on], best[on]
            if not len(rows):
                return done
            at, m = np.arange(len(rows)), ids.shape[1]
            ids[at, best] = new[at, best]
            gone = np.arange(m - 1)[None, :] > best[:, None]
            ids = np.where(gone, ids[:, 1:], ids[:, :-1])
            if m == 2:
                rank, new = rank[:, :0], new[:, :0]
                continue
            gone = np.arange(m - 2)[None, :] >= best[:, None]
            rank, new = np.where(gone, rank[:, 1:], rank[:, :-1]), np.where(gone, new[:, 1:], new[:, :-1])
            for shift in (-1, 0):
                p = best + shift
                ok = np.flatnonzero((p >= 0) & (p < m - 2))
                rank[ok, p[ok]], new[ok, p[ok]] = self._look(ids[ok, p[ok]], ids[ok, p[ok] + 1])

    def _learn(self, words: set[bytes]) -> None:
        if len(self.words) + len(words) > REMEMBER:
            self.words.clear()
        if len(self.pieces) > REMEMBER:
            self.pieces.clear()
        known = self.words
        plain, marked, other = set(), [], []
        for w in words:
            if not self.fast or not w.islower():
                other.append(w)
            elif w.isalpha():  # one piece
                plain.add(w)
            elif w[-1] in _MARKS and w[:-1].isalpha():  # two
                marked.append(w)
                if w[:-1] not in known:
                    plain.add(w[:-1])
            else:
                other.append(w)
        parts: dict[bytes, list[str]] = {}
        for w in other:
            text = w.decode()
            if self.fast and _LETTERS.fullmatch(text):
                plain.add(w)
            elif self.fast and w[-1] in _MARKS and _LETTERS.fullmatch(text, 0, len(text) - 1):
                marked.append(w)
                if w[:-1] not in known:
                    plain.add(w[:-1])
            elif self.fast and _PLAIN.fullmatch(text) and "<|" not in text:
                parts[w] = _PARTS.findall(text.lower())
            else:
                known[w] = self._library(w)
        known.update(self._merged(plain))
        if marked:
            mark = {m: known[b] if (b := bytes([m])) in known else self._library(b) for m in _MARKS}
            for w in marked:
                known[w] = known[w[:-1]] + mark[w[-1]]
        new = {p for x in parts.values() for p in x} - self.pieces.keys()
        raw = {p.encode(): p for p in new}
        self.pieces.update((raw[r], ids) for r, ids in self._merged(raw))
        get = self.pieces.__getitem__
        for w, x in parts.items():
            known[w] = get(x[0]) if len(x) == 1 else b"".join(map(get, x))

    def _library(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, self.kind).tobytes()

    def _merged(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        by: dict[int, list[bytes]] = {}
        for p in pieces:
            by.setdefault(len(p), []).append(p)
        for some in by.values():
            for k in range(0, len(some), 1 << 14):
                part = some[k : k + (1 << 14)]
                yield from zip(part, self._merge(part), strict=True)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, of the width of ``kind``."""
        collecting = gc.isenabled()
        gc.disable()  # nothing below makes cycles, and a scan of the memo costs more than the work
        try:
            return self._ids(texts)
        finally:
            if collecting:
                gc.enable()

    def _ids(self, texts: list[str | None]) -> list[bytes]:
        split = [_split(t) for t in texts]
        missing = set()
        for words in split:
            missing.update(words)
        if len(self.words) + len(missing) > REMEMBER:  # _learn may start anew: all of these texts' words
            new = missing.difference(self.words)
            missing = missing if len(self.words) + len(new) > REMEMBER else new
        else:
            missing = missing.difference(self.words)
        if missing:
            self._learn(missing)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _split(text: str | None) -> list[bytes]:
    """The words of a text; in one that can hold no special token A-Z are lower-cased at once, as the scheme does later."""
    raw = text.encode() if text else b""
    return (raw if b"<|" in raw else raw.lower()).split()


def _byte_characters() -> list[str]:
    """The printable stand-in of every byte: itself where it is printable, else the next code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
