"""Splits of texts into words and pieces, over whole batches.

The patterns of the public vocabularies part a text where the kind of its
characters changes (letters, numbers, spaces, others), with a few rules besides.
Kinds are looked up in a table, so the places of all pieces of a batch are array
operations; equal pieces are then found by dictionary encoding, and only
distinct ones are Python objects.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from parchmint.llm.arrowtext import Texts

SPACE, LETTER, NUMBER, OTHER = range(4)
#: What follows an apostrophe in the contractions of both public patterns.
SHORT = ("s", "t", "m", "d")
LONG = ("re", "ve", "ll")
#: Fixed value: the byte-level vocabularies' pattern, whose splits ``byte_pieces`` finds.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_APOSTROPHE, _BLANK = 0x27, 0x20
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point; made once in a worker."""
    if not _kinds:
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for begin, end in ((0, 0xD800), (0xE000, 0x110000)):
                for m in regex.finditer(pattern, "".join(map(chr, range(begin, end)))):
                    table[begin + m.start() : begin + m.end()] = kind
        _kinds.append(table)
    return _kinds[0]


class Pieces:
    """The pieces of a batch: ``texts`` with each one's bytes begin:end, and the places of each row's pieces."""

    def __init__(self, texts: Texts, begin: np.ndarray, end: np.ndarray):
        self.begin, self.end = begin, end
        self.at = np.searchsorted(begin, texts.offsets)
        held = texts.bytes
        if len(begin) and ((begin[1:] != end[:-1]).any() or begin[0] or end[-1] != len(held)):
            inside = np.zeros(len(held) + 1, np.int8)
            inside[begin] += 1  # no two pieces begin or end at one place
            inside[end] -= 1
            held = held[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        values = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))])
        coded = pc.dictionary_encode(values)
        #: The distinct pieces as an array, and for each piece its place among them.
        self.dictionary = coded.dictionary
        self.index = coded.indices.to_numpy()

    @cached_property
    def distinct(self) -> list[bytes]:
        return self.dictionary.to_pylist()

    def joined(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ``values`` gives for the distinct pieces, for all pieces in order, and the rows' places in them."""
        return gathered(pa.array(values, pa.large_binary()), self.index, self.at)

    def sums(self, values: list[int]) -> np.ndarray:
        """Per row, the sum of what ``values`` gives for its pieces."""
        total = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[self.index])])
        return total[self.at[1:]] - total[self.at[:-1]]


def gathered(table: pa.Array, index: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the table's entries at ``index`` after each other, and where in them each slice at[i]:at[i + 1] is."""
    out = table.take(pa.array(index))
    _, offsets, data = out.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(out) + 1] if len(out) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends[at]


def shared_prefixes(ordered: list[bytes], width: int = 32) -> list[int]:
    """For each of some pieces in order, how many of its first ``width`` bytes the one before shares."""
    if not ordered:
        return []
    cut = np.array(ordered, f"S{width}").view(np.uint8).reshape(-1, width)
    same = np.zeros(len(ordered), np.int64)
    same[1:] = np.where((cut[1:] == cut[:-1]).all(axis=1), width, (cut[1:] != cut[:-1]).argmax(axis=1))
    sizes = np.fromiter(map(len, ordered), np.int64, len(ordered))
    same[1:] = np.minimum(same[1:], np.minimum(sizes[1:], sizes[:-1]))
    return same.tolist()


def _runs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Code points, their kinds, flags of rows' first ones and of changes of kind, and their places in bytes (None: the same)."""
    data = texts.bytes
    if data.max(initial=0) < 128:
        points, place, first_at = data, None, texts.offsets
    else:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        first_at = np.searchsorted(place, texts.offsets)
    kind = kinds()[points]
    first = np.zeros(len(points) + 1, bool)
    first[first_at] = True
    first = first[:-1]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    return points, kind, first, start, place


def _contractions(points: np.ndarray, first: np.ndarray, start: np.ndarray, spaced: bool) -> None:
    """Move the starts after lone apostrophes that begin a contraction; with ``spaced`` a blank before takes them to it."""
    n = len(points)
    q = np.flatnonzero(points[:-1] == _APOSTROPHE) if n else np.zeros(0, np.int64)
    q = q[start[q] & start[q + 1] & ~first[q + 1]]
    if spaced and len(q):
        q = q[first[q] | (points[q - 1] != _BLANK)]
    if not len(q):
        return
    one = np.isin(points[q + 1], [ord(c) for c in SHORT])
    has = q + 2 < n
    after = np.where(has, q + 2, 0)
    two = np.zeros(len(q), bool)
    for a, b in LONG:
        two |= (points[q + 1] == ord(a)) & (points[after] == ord(b))
    two &= has & ~first[after]
    for some, size in ((q[one], 2), (q[two & ~one], 3)):
        start[some + 1] = False
        ends = some + size
        start[ends[ends < n]] = True


def byte_pieces(texts: Texts) -> Pieces:
    """The matches of ``BYTE_PATTERN``, which cover the texts."""
    points, kind, first, start, place = _runs(texts)
    _contractions(points, first, start, True)
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])  # the last space before a word stands alone or joins it
    start[last] = True
    start[last[points[last] == _BLANK] + 1] = False
    begin = np.flatnonzero(start)
    if place is not None:
        begin = place[begin]
    return Pieces(texts, begin, np.append(begin[1:], len(texts.bytes)) if len(begin) else begin)


def words(texts: Texts) -> Pieces:
    """Runs of letters, single numbers, runs of others, and contractions, as the word-end vocabulary splits."""
    points, kind, first, start, place = _runs(texts)
    start |= kind == NUMBER
    _contractions(points, first, start, False)
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(points)) if len(begin) else begin
    full = kind[begin] != SPACE
    begin, end = begin[full], end[full]
    if place is not None:
        place = np.append(place, len(texts.bytes))
        begin, end = place[begin], place[end]
    return Pieces(texts, begin, end)


class Recent:
    """Results by key in two generations, together at most about ``limit``.

    When the young generation holds half of the limit it becomes the old one, and what the old
    one held is forgotten. A key that is asked for again moves to the young one, so what
    recurs lives on and the long tail is made anew when it comes again.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def fetch(self, keys: list, make: Callable[[list], list]) -> list:
        """The results for distinct keys; ``make`` gives those that are not held."""
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        need = []
        for i, value in enumerate(found):
            if value is None:
                value = old.get(keys[i])
                if value is None:
                    need.append(i)
                else:
                    found[i] = young[keys[i]] = value
        if need:
            wanted = [keys[i] for i in need]
            for i, key, value in zip(need, wanted, make(wanted), strict=True):
                found[i] = young[key] = value
        if 2 * len(young) > self.limit:
            self.old, self.young = young, {}
        return found

    def clear(self) -> None:
        self.young, self.old = {}, {}
