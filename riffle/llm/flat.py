"""Numpy helpers over many texts laid end to end in one byte array."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: White space that ends a word: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit permutation of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums whose differences are hashes of stretches: see ``stretch_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data))[0], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes, the same wherever it stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a line feed behind each, and where each starts (one more at the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=starts[1:])
    return data, starts


def words_of(texts: list[bytes], kinds: np.ndarray = ~BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the number of words before each text (one more at the
    end). Words are the longest runs of bytes of one kind; bytes of kind 0 stand between words, and the
    line feed must be one. By default words are runs without ASCII white space."""
    data, starts = lay_out(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kind = kinds[data]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
    own = kind[edge[:-1]] != 0
    begin, end = edge[:-1][own], edge[1:][own]
    hashes = stretch_hash(prefix_hash(data), begin, end)
    return hashes, np.searchsorted(begin, starts)


def chunks(texts: list[bytes], limit: int = 1 << 21):
    """Index ranges of consecutive texts of about ``limit`` bytes together."""
    yield from _ranges(np.fromiter(map(len, texts), np.int64, len(texts)), limit)


def _ranges(sizes: np.ndarray, limit: int):
    upto = np.cumsum(sizes + 1)
    start, held = 0, 0
    while start < len(sizes):
        end = min(len(sizes), int(np.searchsorted(upto, held + limit)) + 1)
        yield start, end
        start, held = end, int(upto[end - 1])


def text_slices(batch, column: str = "text", limit: int = 1 << 20):
    """(slice of the batch, its texts) for slices of about ``limit`` bytes of text, so that a task never
    holds a whole Arrow batch as Python strings. Null texts are empty."""
    for part in slices(batch, column, limit):
        yield part, [t or "" for t in part.column(column).to_pylist()]


def slices(batch, column: str, limit: int):
    """Slices of the batch with about ``limit`` bytes in a column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for s, e in _ranges(sizes.astype(np.int64), limit):
        yield batch.slice(s, e - s)


def spread_ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 3]: owners [0 0 1 1 1] and places [0 1 0 1 2]."""
    owners = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owners, np.arange(len(owners)) - np.repeat(first, counts)
