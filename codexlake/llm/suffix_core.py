"""Numpy kernels of suffix-array deduplication: anchors, suffix arrays, common prefixes, fingerprints."""

from __future__ import annotations

import numpy as np

from .minhash_core import mix

#: Bytes a repeated string must have.
LENGTH = 200
#: Bytes that decide an anchor, and start positions a window of anchors spans: together within LENGTH.
GRAM = 64
SPAN = LENGTH - GRAM + 1
#: Bits of a position in one suffix array: three positions are packed in one number.
BITS = 21
_BASE = 0x9E3779B97F4A7C15 | 1
_ALL = (1 << 64) - 1


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Of each position with ``width`` bytes from it, a polynomial hash of them."""
    n = len(data)
    if n < width:
        return np.empty(0, np.uint64)
    power, span = mix(data.astype(np.uint64) + np.uint64(_BASE)), 1  # hashes of ``span`` bytes
    out, done, step = None, 0, _BASE
    while True:
        if width & span:
            if out is None:
                out = power[: n - width + 1] if span == width else power
            else:
                m = n - done - span + 1
                out = out[:m] * np.uint64(step) + power[done : done + m]
            done += span
            if done == width:
                return out
        power = power[: n - 2 * span + 1] * np.uint64(step) + power[span : n - span + 1]
        span, step = 2 * span, step * step & _ALL


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs ``(first, last, key)`` of start positions of whole LENGTH-byte strings that share an anchor.

    ``data``: bytes of several texts, one after another; ``ends``: of each position, its text's end.
    The anchor of a start ``p`` is the position in ``[p, p + SPAN)`` with the least hash of its GRAM bytes,
    the last of equals, and ``key`` is that hash.  It depends on the LENGTH bytes from ``p`` alone, so equal
    strings have anchors with equal bytes at equal places in them, wherever they occur.
    """
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = mix(rolling(data, GRAM))
    m = len(h)
    # high half: hash, low half: position from the right, so that a minimum is the last of the least
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, 0, -1, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: m - SPAN + 1], low[SPAN - width : SPAN - width + m - SPAN + 1])
    low = low[: n - LENGTH + 1]
    start = np.flatnonzero(ends[: len(low)] - np.arange(len(low)) >= LENGTH)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    anchor = m - (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last], h[anchor[first]]


def _numbered(new: np.ndarray) -> np.ndarray:
    """Of each place, the place where its group starts."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new), dtype=np.int32), np.int32(0)))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (under 2^BITS bytes) in the order of their first ``depth`` bytes at least; equals by position.

    Larsson-Sadakane: suffixes are grouped by their first ``h`` symbols, and a group of more than one is
    sorted again by the groups of the suffixes ``h`` further on, which doubles ``h``.  Groups of one are
    never touched again.  Group, further group and position are packed in one number, so that every
    round sorts plain numbers.
    """
    n = len(text)
    mask, one, two = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(2 * BITS)
    padded = np.zeros(n + 5, np.uint64)
    padded[:n] = text
    packed = np.zeros(n, np.uint64)
    for k in range(5):
        packed = (packed << np.uint64(8)) | padded[k : n + k]
    packed = (packed << one) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & mask).astype(np.int32)
    packed >>= one
    new = np.ones(n, bool)
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    group = _numbered(new)  # a group's number: the place of its first member
    rank = np.empty(n, np.int32)
    rank[order] = group
    h = 5
    at = np.arange(n, dtype=np.int32)  # places that still belong to groups of several
    while h < depth:
        several = np.zeros(len(at), bool)
        several[1:] = group[1:] == group[:-1]
        several[:-1] |= several[1:].copy()
        at, group = at[several], group[several]
        if not len(at):
            break
        here = order[at]
        further = np.where(here + h < n, rank[np.minimum(here + h, n - 1)] + 1, np.int32(0))
        # groups lie in their order already, so this sort keeps them in place
        packed = (group.astype(np.uint64) << two) | (further.astype(np.uint64) << one) | here.astype(np.uint64)
        packed.sort()
        here = (packed & mask).astype(np.int32)
        order[at] = here
        packed >>= one
        new = np.ones(len(at), bool)
        np.not_equal(packed[1:], packed[:-1], out=new[1:])
        group = at[_numbered(new)]
        rank[here] = group
        h *= 2
    return order


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number; bytes past the end are 0."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text) + 1].copy().view(np.uint64)[:, 0]


def _shared(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the texts from ``a`` and ``b`` share before either ends; pair by pair, eight at a time."""
    n = len(words) - 1
    out = np.zeros(len(a), np.int32)
    live, shift = np.arange(len(a)), 0
    high, ones = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101)
    while len(live):
        x, y = words[np.minimum(a[live] + shift, n)], words[np.minimum(b[live] + shift, n)]
        # the lowest bit of what differs, or of a byte that is 0, tells how many bytes agree
        stop = (x ^ y) | (((x - ones) & ~x) & high)
        same = stop == 0
        low = stop & (~stop + np.uint64(1))
        out[live] += np.where(same, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        live = live[same]
        shift += 8
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each place in ``order`` but the first, symbols that its suffix shares with the one before it; 0 ends a text.

    Kasai's observation in its array form: where the predecessor of position ``i`` is one past the
    predecessor of ``i - 1``, the value is that of ``i - 1`` less one.  Only the other positions are
    compared symbol by symbol, all at once.
    """
    n = len(order)
    if n < 2:
        return np.zeros(n, np.int64)
    words = _words(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    plain = np.ones(n, bool)
    plain[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (text[:-1] == 0)
    value = np.zeros(n, np.int32)
    a = np.flatnonzero(plain & (before >= 0))
    value[a] = _shared(words, a, before[a])
    head = _numbered(plain)
    value = np.maximum(value[head] - (np.arange(n, dtype=np.int32) - head), 0)
    # past the end of a run, where its value reached 0, a pair is compared for itself
    late = np.flatnonzero((value == 0) & ~plain & (before >= 0))
    value[late] = _shared(words, late, before[late])
    out = value[order]
    out[0] = 0
    return out


def repeated(text: np.ndarray, whole: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of each position of ``text`` (pieces, each ended by a 0), from its suffix array: whether its ``length`` bytes
    start at another position too, and whether it is the first in suffix order of those that share them.

    ``whole``: positions with ``length`` bytes left in their piece; others are neither.
    """
    order = suffix_array(text, length)
    chain = common_prefixes(text, order) >= length
    again, lead = np.zeros(len(text), bool), np.zeros(len(text), bool)
    again[order] = chain | np.append(chain[1:], False)
    lead[order] = ~chain
    return again & whole, lead & whole
