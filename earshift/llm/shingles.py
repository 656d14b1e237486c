"""Word and shingle hashes of many texts at once, in numpy.

Words are runs of other bytes than ASCII white space; A-Z count as a-z.  All
work is on arrays over a block of bytes, so memory is bounded by the block (or
the longest word), whatever the length of a text.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 20
SHINGLE = 5
ORDER = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Words:
    """Hashes words; keeps the tables of powers."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, BLOCK), powers(INVERSE, BLOCK)

    def block(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each word of a block; ``first`` marks bytes that begin a text."""
        if len(data) > len(self.up):
            self.up, self.down = powers(BASE, len(data)), powers(INVERSE, len(data))
        low = LOWER[data]
        solid = ~SPACE[low]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | first[1:]
        s = np.flatnonzero(begin)
        if not len(s):
            return s, np.zeros(0, np.uint64)
        end = solid.copy()
        end[:-1] &= ~solid[1:] | first[1:]
        e = np.flatnonzero(end)
        total = np.cumsum(np.where(solid, (low.astype(np.uint64) + U(1)) * self.up[:len(low)], U(0)), dtype=np.uint64)
        before = np.where(s > 0, total[np.maximum(s - 1, 0)], U(0))
        return s, mix((total[e] - before) * self.down[s])

    def of(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every word; text k begins at byte ``starts[k]`` and is not empty there."""
        first = np.zeros(len(data), bool)
        first[starts[starts < len(data)]] = True
        at, texts, codes = 0, [], []
        while at < len(data):
            to = min(len(data), at + BLOCK)
            while to < len(data) and not (SPACE[data[to]] or first[to]):
                # the next white space, or a text's beginning, ends the block
                look = data[to:to + BLOCK]
                stop = np.flatnonzero(SPACE[look] | first[to:to + len(look)])
                to = to + int(stop[0]) if len(stop) else to + len(look)
            s, h = self.block(data[at:to], first[at:to])
            texts.append(np.searchsorted(starts, s + at, "right") - 1)
            codes.append(h)
            at = to
        if not codes:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(texts), np.concatenate(codes)


def shingles(text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every window of five words; a text of one to four words is
    one shingle by itself."""
    parts, n = [], len(code)
    if n >= SHINGLE:
        s = np.zeros(n - SHINGLE + 1, np.uint64)
        for k, c in enumerate(ORDER):
            s += code[k:n - SHINGLE + 1 + k] * U(c)
        ok = text[:n - SHINGLE + 1] == text[SHINGLE - 1:]
        parts.append((text[:n - SHINGLE + 1][ok], mix(s[ok])))
    if n:
        head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        size = np.diff(np.r_[head, n])
        few = size < SHINGLE
        head, size = head[few], size[few]
        s = np.full(len(head), 1, np.uint64)
        for k, c in enumerate(ORDER[:-1]):
            s += np.where(k < size, code[np.minimum(head + k, n - 1)] * U(c), U(0))
        parts.append((text[head], mix(s + size.astype(np.uint64))))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def bags(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted."""
    o = np.lexsort((shingle, text))
    t, s = text[o], shingle[o]
    if not len(t):
        return t, s, np.zeros(0, np.int64)
    head = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
    return t[head], s[head], np.diff(np.r_[head, len(t)])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row begins and ends; null rows are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def chunks(at: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_bags(words: Words, data: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags of rows lo to hi, numbered from 0."""
    begin = at[lo:hi] - at[lo]
    text, code = words.of(data[at[lo]:at[hi]], begin)
    return bags(*shingles(text, code))
