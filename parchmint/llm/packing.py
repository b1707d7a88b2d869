"""Hierarchical packing of tokenised documents into windows of several sizes.

A document fills whole windows of the largest size first; what is left goes to
the smallest tier that holds it. Tiers are packed from the longest down: the
longest piece opens a window of its tier, the largest pieces that fit fill the
gap, and where none fits a piece is cut to the gap, so every window is exactly
full. The last tokens of a partition, less than one largest window, go to
windows of powers of two. Partitions are packed by themselves, without a
shuffle, with a pool of bounded size. Windows of one tier form step groups of
equal token counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import bounded_batches, pieces, tidied

TIERS = (512, 1024, 2048, 4096)
#: Tokens of each step group, alike for every tier.
STEP_TOKENS = 8 * 4096
#: Bytes of waiting pieces, with so many for each one's own keeping, down to which gaps are filled when twice as many wait.
POOL_BYTES, PIECE_BYTES = 1 << 21, 256
SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs one partition; ``ready`` holds the rows of finished windows."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.largest = tiers, tiers[-1]
        self.base = partition << 32
        self.windows = 0
        self.groups: dict[int, tuple[int, int]] = {}
        self.next_group = 0
        self.pool: list[tuple[int, int]] = []
        self.held: dict[int, tuple[object, bytes, int, int]] = {}
        self.serial = self.tokens = 0
        self.ready: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        """Take a document's little-endian 32-bit ids."""
        at, end = 0, len(ids) // 4
        while end - at >= self.largest:
            self._emit(self.largest, [(doc, ids[4 * at : 4 * (at + self.largest)], at, end)])
            at += self.largest
        self._wait(doc, ids[4 * at :], at, end)
        if self.waiting() >= 2 * POOL_BYTES:
            self.pack(POOL_BYTES)

    def waiting(self) -> int:
        """Bytes that the pool holds: of a waiting piece only its own ids stay."""
        return 4 * self.tokens + PIECE_BYTES * len(self.pool)

    def _wait(self, doc, ids: bytes, start: int, total: int) -> None:
        if ids:
            length = len(ids) // 4
            self.serial += 1
            insort(self.pool, (length, self.serial))
            self.held[self.serial] = (doc, ids, start, total)
            self.tokens += length

    def _take(self, i: int) -> tuple:
        length, serial = self.pool.pop(i)
        self.tokens -= length
        return self.held.pop(serial)

    def pack(self, leave: int) -> None:
        """Pack whole windows until at most ``leave`` bytes, or less than a largest window, wait."""
        while self.waiting() > leave and self.tokens >= self.largest:
            longest = self.pool[-1][0]
            self._fill(next(t for t in self.tiers if t >= longest), [self._take(-1)])

    def finish(self) -> None:
        self.pack(0)
        size = self.largest
        while self.tokens:
            if self.tokens >= size:
                self._fill(size, [])
            else:
                size //= 2

    def _fill(self, size: int, parts: list[tuple]) -> None:
        gap = size - sum(len(ids) // 4 for _, ids, _, _ in parts)
        while gap:
            i = bisect_right(self.pool, (gap, 1 << 62))
            doc, ids, start, total = self._take(i - 1 if i else 0)
            if len(ids) > 4 * gap:
                self._wait(doc, ids[4 * gap :], start + gap, total)
                ids = ids[: 4 * gap]
            parts.append((doc, ids, start, total))
            gap -= len(ids) // 4
        self._emit(size, parts)

    def _emit(self, size: int, parts: list[tuple]) -> None:
        group, used = self.groups.get(size, (-1, STEP_TOKENS))
        if used + size > STEP_TOKENS:
            group, used = self.next_group, 0
            self.next_group += 1
        self.groups[size] = (group, used + size)
        sequence, offset = self.base + self.windows, 0
        self.windows += 1
        for doc, ids, start, total in parts:
            length = len(ids) // 4
            self.ready.append((doc, start, length, zlib.crc32(ids), total, sequence, offset, size, self.base + group))
            offset += length


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row for each piece of a document, with its window, place and step group.

    ``path`` is a tokenizer file of the library ``tokenizers``; ``end_id`` follows
    every document, so a null or empty text has one token. Texts of any length
    are cut at window ends only. Repeated rows and rows with a null id are
    packed as documents of their own. An empty table gives no rows.
    ``tiers`` are ascending powers of two.
    """
    from parchmint.llm.word_tokens import ChunkIds

    end = end_id.to_bytes(4, "little")
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in SCHEMA.split(", ")]

    def rows(packer: Packer) -> pa.RecordBatch:
        columns = list(zip(*packer.ready, strict=True)) or [()] * len(names)
        packer.ready = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    @tidied("packing")
    def pack(batches) -> Iterator[pa.RecordBatch]:
        packer, encoder = Packer(TaskContext.get().partitionId(), tiers), ChunkIds.of(path)
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                for doc, ids in zip(batch.column("id").to_pylist(), encoder.encode_many(batch.column("text")), strict=True):
                    packer.add(doc, ids + end)
                yield rows(packer)
        packer.finish()
        yield rows(packer)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, SCHEMA)
