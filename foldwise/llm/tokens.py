"""Word splitting and rolling hashes over Arrow text columns, vectorised.

Texts of one Arrow batch lie end to end in one byte buffer. Everything here
works on that buffer with numpy: no Python object is made per word. Hashes are
64-bit polynomials over random tables (fixed seed), so equal words and equal
windows have equal hashes in every task of every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: bytes of text handled at once; a longer text is handled alone, whole
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_ALNUM = np.ones(256, dtype=bool)
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: separators between words: the white space of the contracts, or everything
#: that is no ASCII letter or digit (bytes of other scripts belong to words)
SEPARATORS = {"space": _SPACE, "non_alnum": _NOT_ALNUM}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial prefix hashes modulo 2**64 with base ``B``: the hash of any
    span is a difference of two prefix sums times a power of 1/B."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, dtype=np.uint64)) * 8 + 5 & (1 << 64) - 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", self.base), ("down", self.inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            setattr(self, name, np.cumprod(p))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) + 1 > len(self.up):
            self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (prefix[ends] - prefix[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BYTES = (Rolling(11), Rolling(12))
_WORDS = (Rolling(21), Rolling(22))


@dataclass
class Words:
    """The words of consecutive texts. ``first[d]``: index of the first word of
    text d (one more entry than texts); ``starts``, ``ends``: byte places in
    ``data``; ``begin[d]``: byte place of text d."""

    data: np.ndarray
    begin: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    _prefix: dict = field(default_factory=dict)

    def hashes(self, lane: int = 0, longest: int | None = None) -> np.ndarray:
        """Of the words, or of their first ``longest`` bytes."""
        r = _BYTES[lane]
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        if lane not in self._prefix:
            self._prefix[lane] = r.prefix(r.table[self.data])
        return r.spans(self._prefix[lane], self.starts, ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, text begins) for runs of rows
    of about ``limit`` bytes; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, body = column.buffers()
    places = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(places, places[a] + limit, side="right")) - 1)
        yield a, b, body[places[a]:places[b]], places[a:b + 1] - places[a]
        a = b


def split_words(data: np.ndarray, begin: np.ndarray, lower: bool = False, separators: str = "space") -> Words:
    """Words of the texts that lie end to end in ``data``; a word never
    crosses the edge of a text."""
    if lower:
        data = LOWER[data]
    inside = ~SEPARATORS[separators][data]
    n = len(data)
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = begin[1:-1]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, begin, np.searchsorted(starts, begin), starts, ends)


def windows(hashes: np.ndarray, first: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word places at which a window of ``k`` words of one text begins, and
    the windows' hashes."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    ok = np.zeros(n + 1, dtype=np.int64)
    # a text with c words begins windows at its first c - k + 1 places
    counts = np.diff(first)
    has = counts >= k
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, (first[1:] - k + 1)[has], -1)
    at = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    r = _WORDS[lane]
    return at, r.spans(r.prefix(hashes), at, at + k)


def signed(h: np.ndarray) -> np.ndarray:
    """Spark has signed longs only."""
    return h.view(np.int64)
