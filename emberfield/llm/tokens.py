"""Words and their hashes for many texts at once, in numpy on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Bytes of text worked on together; a longer document is a piece of its own.
PIECE = 1 << 20
# Bytes hashed together: the tables of powers are as long.
STRETCH = 1 << 18

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)

            def grown(base: int) -> np.ndarray:
                out = np.full(size, base, dtype=U64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = grown(self.base), grown(self.inverse)
        return self.up[:n], self.down[:n]


BYTES = _Powers(0x9E3779B97F4A7C15)
PLAIN, OTHER = _Powers(0xC2B2AE3D27D4EB4F), _Powers(0x165667B19E3779F9 | 1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ U64(salt)
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hash of ``values[start:end]``, the same wherever the range lies."""
    up, down = powers.take(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


@dataclass
class Words:
    """Words of texts ``first`` to ``first + len(bounds) - 1``: text k has the words ``bounds[k]`` to ``bounds[k + 1]``
    and the bytes ``offsets[k]`` to ``offsets[k + 1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def windows(self, n: int) -> np.ndarray:
        """First words of all windows of ``n`` words inside one text."""
        last = np.repeat(self.bounds[1:], self.counts)
        at = np.arange(len(self.hashes))
        return at[at + n <= last]

    def grams(self, at: np.ndarray, n: int, powers: _Powers = PLAIN) -> np.ndarray:
        """Hashes of the windows of ``n`` words that begin at ``at``."""
        return mix(range_sums(self.hashes, at, at + n, powers), n)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(starts), dtype=U64), 0
    while i < len(starts):  # the tables of powers stay small, also for long texts
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        out[i:j] = range_sums(data[a:b].astype(U64) + U64(1), starts[i:j] - a, ends[i:j] - a, BYTES)
        i = j
    return mix(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without copying; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes, at least one text each."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def split_words(texts: pa.Array, lower: bool = False, gaps: np.ndarray = _SPACES, size: int = PIECE) -> Iterator[Words]:
    """Words (white space of six kinds, or the bytes marked in ``gaps``, between them) of a string column, piece by piece."""
    offsets, data = text_bytes(texts)
    for i, j in pieces(offsets, size):
        part = data[offsets[i]: offsets[j]]
        if lower:
            part = _LOWER[part]
        at = offsets[i: j + 1] - offsets[i]
        word = ~gaps[part]
        begin, end = word.copy(), word.copy()
        if len(word):
            begin[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            inner = at[(at > 0) & (at < len(part))]
            begin[inner] = word[inner]
            end[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Words(i, part, at, np.searchsorted(starts, at), starts, ends, _hash_words(part, starts, ends))
