"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one UTF-8 byte buffer with offsets, so words, hashes and
per-document sums are array operations over the whole batch rather than loops
over words. Nulls read as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parchmint.functions.batches import bounded_batches  # noqa: F401  the operators take it from here

#: Bytes of text that the array operations work on at once; bounds a task's memory.
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space, which alone separates words.
BLANKS = " \t\n\x0b\x0c\r"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the 64 output bits."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
        yield batch.slice(a, b - a)


def as_texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()


class Texts:
    """The bytes of a column of texts, with each row's place in them."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        self.n = len(column)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + self.n + 1].astype(np.int64) if self.n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        if lower:
            self.bytes = _LOWER[self.bytes]
        self.offsets = offsets - offsets[0]

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per row, the sum of a value given for each byte."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words:
    """Maximal runs of bytes other than ASCII white space, in order, never across rows."""

    def __init__(self, texts: Texts):
        self.texts = texts
        b = texts.bytes
        inside = ~_SPACE[b]
        first = np.zeros(len(b) + 1, dtype=bool)
        first[texts.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        self.inside = inside
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        #: Row i has the words at[i]:at[i + 1].
        self.at = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, alike in every process."""
        b = self.texts.bytes
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = powers(len(b) + 1)
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[b] * up[:-1], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix64(h ^ ((self.ends - self.starts).astype(np.uint64) << np.uint64(40)))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.texts.n), self.counts)


_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses; kept up to a bounded length."""
    global _powers
    if len(_powers[0]) < n:
        up, down = (np.full(max(n, 1 << 16), x, dtype=np.uint64) for x in (_BASE, _BASE_INVERSE))
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        if n > 2 * PIECE_BYTES:
            return up[:n], down[:n]
        _powers = up, down
    return _powers[0][:n], _powers[1][:n]


def ngram_hashes(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each row, and the rows' places in them.

    A row with some words but fewer than ``size`` has one run, all its words.
    """
    counts = np.diff(at)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    h = words.copy()
    for k in range(1, size):
        h[: n - k] = mix64(h[: n - k] * _M1 + words[k:])
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    index = np.arange(begin[-1]) + np.repeat(at[:-1] - begin[:-1], runs)
    out = h[index]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        whole = words[at[i] : at[i] + 1]
        for k in range(at[i] + 1, at[i + 1]):
            whole = mix64(whole * _M1 + words[k : k + 1])
        out[begin[i]] = whole[0] ^ np.uint64(counts[i])
    return out, begin


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices, 0 for an empty one (``np.add.reduceat`` has other values there)."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out


_caches: list[dict] = []
_user = ""


def keep_cache(cache: dict) -> dict:
    """Name a worker's cache that goes when another operator's tasks come to the worker."""
    _caches.append(cache)
    return cache


def tidied(name: str) -> Callable:
    """For a function over batches: other operators' caches go before it, unused memory goes back after it."""

    def wrap(fn: Callable) -> Callable:
        def run(batches):
            global _user
            if _user != name:
                _user = name
                for cache in _caches:
                    cache.clear()
                release()
            try:
                yield from fn(batches)
            finally:
                release()

        return run

    return wrap


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass
