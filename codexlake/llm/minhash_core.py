"""Numpy kernels of the MinHash near-duplicate operator.

Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017): in round ``i`` every element of a set throws
one value into one of ``t`` bins; a value of an earlier round always beats one of a later round.  In
rounds ``t .. 2t-1`` every element throws into the one bin ``i - t``, so after ``2t`` rounds each
coordinate is filled whatever the size of the set; a set leaves the rounds as soon as all its bins are
filled, which takes about ``t ln t / n`` rounds.  The coordinates of two sets agree with probability
equal to their Jaccard similarity, with Chernoff-type concentration.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D`` after lower-casing A-Z.  A text with
    fewer than ``width`` words has its whole word sequence as its one shingle; a null text or one
    without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h)
    span = min(width, n)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = mix(out + h[k : n - span + 1 + k] + np.uint64((k + 1) * _STEP & _ALL))
    out.sort()
    keep = np.empty(len(out), bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def sketch(values: np.ndarray, starts: np.ndarray, t: int) -> np.ndarray:
    """``(len(starts) - 1, t)`` coordinates of the sets ``values[starts[i]:starts[i + 1]]``; none empty."""
    docs = len(starts) - 1
    empty = np.uint64(_ALL)
    s = np.full(docs * t, empty, np.uint64)
    owner = np.repeat(np.arange(docs), np.diff(starts))
    for i in range(2 * t):
        x = mix(values + np.uint64((i + 1) * _STEP & _ALL))
        if i < t:
            at = owner * t + ((x >> np.uint64(40)) % np.uint64(t)).astype(np.int64)
        else:
            at = owner * t + (i - t)
        np.minimum.at(s, at, (x & np.uint64((1 << 40) - 1)) | np.uint64(i << 40))
        # rounds after the first only concern sets that still have an empty bin
        open_ = (s.reshape(docs, t) == empty).any(axis=1)
        if not open_.any():
            break
        stay = open_[owner]
        if not stay.all():
            values, owner = values[stay], owner[stay]
    return s.reshape(docs, t)


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band of ``rows`` coordinates; equal bands at one place give equal keys."""
    docs, t = coordinates.shape
    c = coordinates[:, : t // rows * rows].reshape(docs, t // rows, rows)
    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), (docs, t // rows)).copy()
    for k in range(rows):
        key = mix(key * _M2 + c[:, :, k] + np.uint64((k + 1) * _STEP & _ALL))
    return key


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether ``100 * |a & b| >= percent * |a | b|`` for two sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def links_between(sets: list[np.ndarray], groups: np.ndarray, percent: int, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(a, b)`` of linked sets of different groups, one link to a pair of groups at most.

    Intersections are products of 0/1 matrices over the items that occur twice or more, ``width``
    items at a time; float32 holds these counts exactly.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    items = np.concatenate(sets) if n else np.empty(0, np.uint64)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1 if len(items) else np.empty(0, bool)
    take = often[column] if len(items) else np.empty(0, bool)
    column, owner = (np.cumsum(often) - 1)[column[take]] if take.any() else column[:0], owner[take]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    ok = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    ok &= (groups[:, None] < groups[None, :]) & (inter > 0)
    a, b = np.nonzero(ok)
    _, first = np.unique(np.stack([groups[a], groups[b]], 1), axis=0, return_index=True)
    return a[first], b[first]
