"""Token ids in files of independent compressed frames, read back document by document.

A file is a row of zstandard frames, each with the library's own checksum, that decompress by
themselves; together they give the little-endian 32-bit ids of the file's documents, one
after another. Two skippable frames follow, which ordinary readers pass over: the index
(a compressed table of documents) and the seek table, in the public seekable format: for each
frame its compressed and decompressed sizes and the low 32 bits of the content's
xxh64, then a footer of fixed size. A reader takes the end of the file, the index, and
then only the frames that hold the documents it was asked for.

Files are written by tasks and made visible by one manifest, which holds for each file its
documents, tokens, and the tokens of all files before it.
"""

from __future__ import annotations

import io
import json
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from parchmint.llm.arrowtext import bounded_batches, pieces, tidied
from parchmint.llm.scratch import Scratch
from parchmint.sources import committed

#: Bytes of ids in a frame; a longer document goes over several frames.
FRAME_BYTES = 1 << 18
LEVEL = 3
#: Fixed values of the public format: skippable frames, and the last bytes of a seek table.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<III")
#: Bytes of ids in a batch that a reader yields, about.
READ_BYTES = 4 << 20


class Damaged(ValueError):
    """A file whose bytes are not what was written."""


class Builder:
    """Writes one file to a stream; holds one open frame and, for each document, its id and length."""

    def __init__(self, out):
        self.out = out
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.open = bytearray()
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids) // 4)
        if self.open and len(self.open) + len(ids) > FRAME_BYTES:
            self._frame()
        for at in range(0, len(ids), FRAME_BYTES):
            self.open += ids[at : at + FRAME_BYTES]
            if len(self.open) >= FRAME_BYTES:
                self._frame()

    def _frame(self) -> None:
        if self.open:
            packed = self.packer.compress(bytes(self.open))
            self.out.write(packed)
            self.entries.append((len(packed), len(self.open), xxhash.xxh64_intdigest(bytes(self.open)) & 0xFFFFFFFF))
            self.open = bytearray()

    def finish(self) -> None:
        self._frame()
        table = pa.table({"doc": pa.array(self.docs, pa.int64()), "n": pa.array(self.sizes, pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        index = self.packer.compress(sink.getvalue())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 4) + index + struct.pack("<I", xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        # The index is a frame of nothing to the seek table, so that places of frames add up.
        entries = [*self.entries, (len(index) + 12, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(_ENTRY.pack(*e) for e in entries) + _FOOTER.pack(len(entries), _CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)


class File:
    """One file, opened for reading; ``fetched`` counts the frames that were decompressed."""

    def __init__(self, source):
        self.source = source
        self.fetched = 0
        end = source.size()
        n, flags, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        length = n * _ENTRY.size + _FOOTER.size
        head, size = struct.unpack("<II", self._at(end - length - 8, 8))
        if magic != FOOTER_MAGIC or flags != _CHECKSUMS or head != SEEK_MAGIC or size != length or not n:
            raise Damaged("no seek table at the end of the file")
        entries = np.frombuffer(self._at(end - length, n * _ENTRY.size), "<u4").reshape(n, 3).astype(np.int64)
        #: Places of the frames among the file's bytes and among the decompressed ones.
        self.packed = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(entries[:-1, 1])])
        self.sums = entries[:, 2]
        self.reader = zstandard.ZstdDecompressor()
        self._held: tuple[int, bytes] = (-1, b"")
        raw = self._at(int(self.packed[-2]), int(entries[-1, 0]))
        index, check = raw[8:-4], struct.unpack("<I", raw[-4:])[0]
        if xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != check:
            raise Damaged("the index differs from its checksum")
        table = pa.ipc.open_stream(self.reader.decompress(index)).read_all()
        self.docs = table.column("doc").combine_chunks()
        #: Row i has the ids ends[i]:ends[i + 1].
        self.ends = np.concatenate([[0], np.cumsum(table.column("n").to_numpy())]).astype(np.int64)

    def _at(self, begin: int, size: int) -> bytes:
        if begin < 0:
            raise Damaged("the file is cut short")
        self.source.seek(begin)
        found = self.source.read(size)
        if len(found) != size:
            raise Damaged("the file is cut short")
        return found

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            packed = self._at(int(self.packed[k]), int(self.packed[k + 1] - self.packed[k]))
            try:
                plain = self.reader.decompress(packed)
            except zstandard.ZstdError as e:
                raise Damaged(f"frame {k}: {e}") from None
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
                raise Damaged(f"frame {k} differs from its checksum")
            self.fetched += 1
            self._held = (k, plain)
        return self._held[1]

    def ids(self, row: int) -> bytes:
        """The ids of the document in a row of the index."""
        begin, end = 4 * int(self.ends[row]), 4 * int(self.ends[row + 1])
        out = []
        for k in range(bisect_right(self.plain, begin) - 1, bisect_left(self.plain, end)):
            at = int(self.plain[k])
            out.append(self._frame(k)[max(begin - at, 0) : end - at])
        return b"".join(out)

    def rows(self, wanted: set[int] | None) -> np.ndarray:
        """Rows of the index whose documents are wanted (None: all)."""
        if wanted is None:
            return np.arange(len(self.docs))
        return np.flatnonzero(pa.compute.is_in(self.docs, pa.array(sorted(wanted), pa.int64())).to_numpy(zero_copy_only=False))


SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


class TokenFiles(DataSource):
    """``format("parchmint_tokens")``: rows (doc_id, start, n_tokens, ids) of the files in the folder ``path``.

    Written are (doc_id, ids) in the order of the partitions and of their rows. The option ``wanted``, a
    JSON list of doc_ids, leaves out files by their least and largest id, and within a file all frames of other documents.
    """

    @classmethod
    def name(cls) -> str:
        return "parchmint_tokens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TokenReader(self.options["path"], self.options.get("wanted"))

    def writer(self, schema, overwrite):
        return TokenWriter(self.options["path"], overwrite)


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, committed.new_job()

    def write(self, iterator):
        folder, name = committed.Folder(self.path), committed.own_name(self.job, ".ids.zst")
        partition = TaskContext.get().partitionId()
        builder = out = None
        least = largest = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if builder is None:
                out = folder.create(name)
                builder = Builder(out)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                builder.add(doc, ids.as_py() or b"")
                if doc is not None:
                    least, largest = doc if least is None else min(least, doc), doc if largest is None else max(largest, doc)
        if builder is None:
            return committed.Written(partition, None)
        builder.finish()
        out.close()
        return committed.Written(partition, name, {"docs": len(builder.docs), "tokens": sum(builder.sizes), "least": least, "largest": largest})

    def commit(self, messages):
        committed.commit(committed.Folder(self.path), self.job, messages, self.overwrite)

    def abort(self, messages):
        committed.abort(committed.Folder(self.path), self.job)


class TokenReader(DataSourceReader):
    def __init__(self, path: str, wanted: str | None):
        self.path, self.wanted = path, None if wanted is None else set(json.loads(wanted))

    def partitions(self):
        found, before = [], 0
        for file in committed.committed(committed.Folder(self.path)):
            inside = self.wanted is None or (file["least"] is not None and any(file["least"] <= w <= file["largest"] for w in self.wanted))
            if inside:
                found.append(InputPartition((file["name"], before)))
            before += file["tokens"]
        return found or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        name, before = partition.value
        with committed.Folder(self.path).open(name) as source:
            file = File(source)
            rows, size = [], 0
            for row in file.rows(self.wanted).tolist():
                rows.append((row, file.ids(row)))
                size += len(rows[-1][1])
                if size >= READ_BYTES:
                    yield self._batch(file, rows, before)
                    rows, size = [], 0
            if rows:
                yield self._batch(file, rows, before)

    @staticmethod
    def _batch(file: File, rows: list[tuple[int, bytes]], before: int) -> pa.RecordBatch:
        at = np.array([r for r, _ in rows], np.int64)
        columns = [file.docs.take(pa.array(at)), pa.array(file.ends[at] + before), pa.array(file.ends[at + 1] - file.ends[at]), pa.array([i for _, i in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Rows (doc_id, ids): the ids of each text and ``end_id``, little-endian; partitions and order stay."""
    from parchmint.llm.word_tokens import ChunkIds

    end = end_id.to_bytes(4, "little")

    @tidied("token_files")
    def encode(batches) -> Iterator[pa.RecordBatch]:
        encoder = ChunkIds.of(path)
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                ids = [i + end for i in encoder.encode_many(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def write_tokens(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, mode: str = "overwrite") -> None:
    """Write every text's ids to files in ``folder``, in ascending order of ids over all files.

    ``path`` is a tokenizer file. A null or empty text has the end id alone. Null ids come first; rows of one id
    stand together in the order of their texts' hashes, repeated rows beside each other. An empty
    table writes a manifest without files. Texts are dealt by ranges of ids, so the cost is one shuffle of the texts.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_hash"))
    dealt = keyed.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash")
    encoded(dealt, path, "_id", "_text", end_id).write.format("parchmint_tokens").mode(mode).save(folder)


def read_tokens(spark, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a folder's files; ``start`` counts the ids of all documents before.

    With ``wanted`` only the frames that hold those documents are decompressed. A damaged
    file raises ``Damaged``.
    """
    spark.dataSource.register(TokenFiles)
    reader = spark.read.format("parchmint_tokens")
    if wanted is not None:
        reader = reader.option("wanted", json.dumps(sorted(set(wanted))))
    return reader.load(folder)


def written_and_read(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read from files that are written to the shared folder first."""
    spark = docs.sparkSession
    folder = committed.qualified(spark, f"{Scratch(spark, 'tokens').root}/files")
    write_tokens(docs, path, folder, id_col, text_col, end_id)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
