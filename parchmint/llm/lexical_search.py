"""Ranked lexical search over a clustered index of documents reordered by recursive graph bisection.

``build_index`` takes documents as they come, in blocks of bounded size, and reorders each
block: a range of documents is halved, and pairs of documents change sides while that lowers the
estimated bits of the gaps in the terms' posting lists; the halves go on alike. Documents that share terms come
to stand side by side, and runs of ``CLUSTER`` neighbours are the clusters. A block is one row of
the index: its documents in their new order, its terms, their postings and, for every
cluster, the largest contribution of each term. Nothing is shuffled.

``search`` sends the items' terms and weights to the blocks. In a block, clusters are visited by
the bound of their best possible score, until the bound of the next one is below the score of the
worst result that is held; equal bounds are visited, since a lower doc_id may win there. The best rows
of every task, mapped back to doc_ids, are ranked over all.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import Texts, bounded_batches, pieces, tidied
from parchmint.llm.scratch import Scratch
from parchmint.llm.splitting import Pieces

#: Documents and bytes of text from which a block is closed; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
#: Blocks of a row group of the stored index: what a task's writer or reader holds at once.
GROUP_BLOCKS = 2
#: Documents of a cluster, and rounds of exchanges on every level of the bisection.
CLUSTER, EXCHANGES = 64, 8
#: Items, and their distinct terms, that are sent to the blocks at once; further items come in further passes.
PASS_ITEMS, PASS_TERMS = 1024, 8192
#: Bytes of the contributions that a search unfolds at once; beyond it terms are scored in their sparse form.
UNFOLD_BYTES = 64 << 20
TOP = 20
#: The weight's and the contribution's scales, and the share of the length in the norm.
WEIGHT_SCALE, PART_SCALE, NORM, LENGTH_SHARE = 1000, 1_000_000_000, 100, 25

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_INDEX = "block long, n_docs long, ids binary, known binary, terms array<binary>, at binary, slots binary, parts binary, clusters binary, tops binary"


def terms_of(column: pa.Array) -> Pieces:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case."""
    texts = Texts(column, lower=True)
    inside = _TERM[texts.bytes]
    first = np.zeros(len(inside) + 1, bool)
    first[texts.offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    return Pieces(texts, np.flatnonzero(starts), np.flatnonzero(ends) + 1)


def _savings(size: int, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a half of ``size`` documents and a term's degree there: the bits that one document less saves, and one more."""
    degree = np.arange(size + 2)
    bits = degree * (np.log2(max(size, 1)) - logs[degree])
    return np.concatenate([[0.0], np.diff(bits)]), np.append(-np.diff(bits), 0.0)


def _gains(terms: np.ndarray, at: np.ndarray, side: np.ndarray, second: np.ndarray, n_terms: int, logs: np.ndarray) -> np.ndarray:
    """For each document, the estimated bits that changing its side saves."""
    both = np.bincount(terms, minlength=n_terms)
    there = np.bincount(terms[second], minlength=n_terms)
    sizes = int((~side).sum()), int(side.sum())
    (less_one, more_one), (less_two, more_two) = (_savings(n, logs) for n in sizes)
    here = both - there
    saved = np.concatenate([less_one[here] + more_two[there], less_two[there] + more_one[here]])
    total = np.concatenate([[0.0], np.cumsum(saved[terms + second * n_terms])])
    return total[at[1:]] - total[at[:-1]]


def _shared(terms: np.ndarray, at: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The same documents without terms that stand in one of them only, which move nothing; terms are numbered anew."""
    told = np.bincount(terms, minlength=n_terms) > 1
    number = np.cumsum(told) - 1
    keep = told[terms]
    return number[terms[keep]], np.concatenate([[0], np.cumsum(keep)])[at], int(told.sum())


def bisected(terms: np.ndarray, at: np.ndarray, n_terms: int, leaf: int = CLUSTER) -> np.ndarray:
    """An order of documents; document i has the distinct terms ``terms[at[i]:at[i + 1]]``."""
    logs = np.log2(np.arange(len(at) + 2) + 1.0)
    out: list[np.ndarray] = []
    todo = [(np.arange(len(at) - 1), terms, at, n_terms)]
    while todo:
        docs, terms, at, n_terms = todo.pop()
        if len(docs) <= leaf:
            out.append(docs)
            continue
        terms, at, n_terms = _shared(terms, at, n_terms)
        sizes = np.diff(at)
        # Halves end at whole clusters, so that clusters of the final order are leaves.
        half = -(-len(docs) // (2 * leaf)) * leaf
        side = np.arange(len(docs)) >= half
        for _ in range(EXCHANGES):
            gain = _gains(terms, at, side, np.repeat(side, sizes), n_terms, logs)
            one, two = np.flatnonzero(~side), np.flatnonzero(side)
            one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
            pairs = min(len(one), len(two))
            better = gain[one[:pairs]] + gain[two[:pairs]] > 1e-9
            side[one[:pairs][better]], side[two[:pairs][better]] = True, False
            if better.sum() <= len(docs) // 100:
                break
        second = np.repeat(side, sizes)
        for which in (True, False):  # the first half is taken next
            todo.append((docs[side == which], terms[second == which], np.concatenate([[0], np.cumsum(sizes[side == which])]), n_terms))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _block(number: int, ids: pa.Array, found: list[Pieces], n_docs: int, n_terms: int) -> dict:
    """One row of the index."""
    coded = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(f.index, pa.int32()), f.dictionary) for f in found]).unify_dictionaries()
    vocabulary = coded.chunk(0).dictionary
    row0 = sum(len(f.at) - 1 for f in found)
    width = max(len(vocabulary), 1)
    rows = np.repeat(np.arange(row0), np.concatenate([np.diff(f.at) for f in found]))
    terms = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    pairs, tf = np.unique(rows * width + terms, return_counts=True)
    row, term = np.divmod(pairs, width)
    lengths = np.bincount(row, weights=tf, minlength=row0).astype(np.int64)
    norm = NORM - LENGTH_SHARE + (LENGTH_SHARE * lengths * n_docs) // max(n_terms, 1)
    part = (PART_SCALE * tf) // (1000 * tf + 12 * norm[row])
    order = bisected(term, np.searchsorted(row, np.arange(row0 + 1)), width)
    slot = np.empty(row0, np.int64)
    slot[order] = np.arange(row0)
    # Postings by term and new place; where a term's place passes into another cluster, a bound begins.
    place = slot[row]
    by = np.argsort(term * max(row0, 1) + place)
    term, place, part = term[by], place[by], part[by]
    cell = term * (row0 // CLUSTER + 1) + place // CLUSTER
    begins = np.flatnonzero(np.diff(cell, prepend=-1))
    tops = np.maximum.reduceat(part, begins) if len(begins) else part
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=width))])
    cells = np.searchsorted(begins, starts)
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)[order]
    return {
        "block": number,
        "n_docs": row0,
        "ids": pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8")[order].tobytes(),
        "known": known.astype(np.uint8).tobytes(),
        "terms": vocabulary,
        "at": np.stack([starts, cells]).astype("<i8").tobytes(),
        "slots": place.astype("<i4").tobytes(),
        "parts": part.astype("<i4").tobytes(),
        "clusters": (place[begins] // CLUSTER).astype("<i4").tobytes(),
        "tops": tops.astype("<i4").tobytes(),
    }


def collection_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """The number of documents with a term, and of all their terms with repeats."""

    @tidied("lexical_search")
    def count(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                texts = Texts(batch.column("text"))
                inside = _TERM[texts.bytes]
                first = np.zeros(len(inside) + 1, bool)
                first[texts.offsets] = True
                starts = inside.copy()
                starts[1:] &= ~inside[:-1] | first[1:-1]
                some = texts.sums(starts)
                yield pa.RecordBatch.from_arrays([pa.array([int((some > 0).sum())]), pa.array([int(some.sum())])], names=["docs", "terms"])

    bounded_batches(docs.sparkSession)
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return int(found[0] or 0), int(found[1] or 0)


def build_index(docs: DataFrame, size: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of the index, one row each; ``size`` is that of ``collection_size``."""

    @tidied("lexical_search")
    def build(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, found, held, length = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            row = _block(number, pa.concat_arrays(ids), found, *size)
            kinds = {"block": pa.int64(), "n_docs": pa.int64()}
            terms = row["terms"].cast(pa.binary())
            columns = [pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms) if k == "terms" else pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()]
            return pa.RecordBatch.from_arrays(columns, names=list(row))

        for whole in batches:
            for batch in pieces(whole, "text"):
                bytes_ = batch.column("text").nbytes
                if held and (held + batch.num_rows > BLOCK_DOCS or length + bytes_ > BLOCK_BYTES):
                    yield closed()
                    number += 1
                    ids, found, held, length = [], [], 0, 0
                ids.append(batch.column("id"))
                found.append(terms_of(batch.column("text")))
                held += batch.num_rows
                length += bytes_
        if held:
            yield closed()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(build, _INDEX)


def document_frequencies(index: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """In how many documents of the index each of some terms stands."""

    @tidied("lexical_search")
    def count(batches) -> Iterator[pa.RecordBatch]:
        values = pa.array(wanted, pa.binary())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, at in zip(batch.column("terms"), batch.column("at"), strict=True):
                starts = np.frombuffer(at.as_py(), "<i8").reshape(2, -1)[0]
                where = pc.index_in(values, terms.values.cast(pa.binary())).to_numpy(zero_copy_only=False)
                here = np.flatnonzero(~np.isnan(where)) if where.dtype.kind == "f" else np.arange(len(where))
                there = where[here].astype(np.int64)
                total[here] += starts[there + 1] - starts[there]
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[here])], names=["term", "df"])

    rows = index.select("terms", "at").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # the wanted terms at most
    return {wanted[r["term"]]: r["df"] for r in rows}


class Block:
    """One block, unfolded for the terms of a pass."""

    def __init__(self, row: dict, wanted: pa.Array):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        starts, cells = np.frombuffer(row["at"], "<i8").reshape(2, -1)
        slots, parts = np.frombuffer(row["slots"], "<i4"), np.frombuffer(row["parts"], "<i4")
        clusters, tops = np.frombuffer(row["clusters"], "<i4"), np.frombuffer(row["tops"], "<i4")
        where = pc.fill_null(pc.index_in(wanted, row["terms"]), -1).to_numpy(zero_copy_only=False)
        #: For each wanted term its line in the tables below, or -1.
        self.line = np.full(len(wanted), -1, np.int64)
        here = np.flatnonzero(where >= 0)
        self.line[here] = np.arange(len(here))
        self.n_clusters = -(-len(self.ids) // CLUSTER)
        #: For each line the places and contributions of its documents, and those of its bounds.
        self.postings = [(slots[starts[t] : starts[t + 1]], parts[starts[t] : starts[t + 1]]) for t in where[here].tolist()]
        bounds = [(clusters[cells[t] : cells[t + 1]], tops[cells[t] : cells[t + 1]]) for t in where[here].tolist()]
        #: Tables of lines by clusters and by places; without them (too many lines) scores are added up line by line.
        self.tops = self.parts = None
        if 4 * len(here) * self.n_clusters * CLUSTER <= UNFOLD_BYTES:
            self.tops = np.zeros((len(here), self.n_clusters), np.int64)
            self.parts = np.zeros((len(here), self.n_clusters * CLUSTER), np.int32)
            for i, ((some, values), (cluster, top)) in enumerate(zip(self.postings, bounds, strict=True)):
                self.parts[i, some], self.tops[i, cluster] = values, top
        self.bounds = bounds

    def _summed(self, entries: list, lines: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for line, weight in zip(lines.tolist(), weights.tolist(), strict=True):
            where, values = entries[line]
            total[where] += weight * values.astype(np.int64)
        return total

    def visit(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple], top: int) -> int:
        """Put the block's documents for an item into ``best``, a heap of its ``top`` results; returns how many clusters were visited."""
        lines = self.line[terms]
        weights, lines = weights[lines >= 0], lines[lines >= 0]
        if not len(lines):
            return 0
        if self.parts is None:
            bounds = self._summed(self.bounds, lines, weights, self.n_clusters)
            all_scores = self._summed(self.postings, lines, weights, self.n_clusters * CLUSTER)
        else:
            bounds = weights @ self.tops[lines]
        seen = 0
        for c in np.argsort(-bounds, kind="stable").tolist():
            if bounds[c] <= 0 or (len(best) == top and bounds[c] < best[0][0]):
                break
            seen += 1
            begin = c * CLUSTER
            scores = all_scores[begin : begin + CLUSTER] if self.parts is None else weights @ self.parts[lines, begin : begin + CLUSTER]
            least = best[0][0] if len(best) == top else 1
            for k in np.flatnonzero(scores >= least).tolist():
                # Larger is better: the score, then the lower id, a null one first.
                entry = (int(scores[k]), -int(self.ids[begin + k]) if self.known[begin + k] else math.inf)
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return seen


def _passes(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items in bounded numbers, each with its terms."""
    some: list[tuple[int | None, Counter]] = []
    terms: set[bytes] = set()
    for row in items.toLocalIterator():
        found = terms_of(pa.array([row["text"]], pa.string()))
        mine = Counter(found.distinct[i] for i in found.index.tolist())
        if some and (len(some) == PASS_ITEMS or len(terms | mine.keys()) > PASS_TERMS):
            yield some
            some, terms = [], set()
        some.append((row["item"], mine))
        terms |= mine.keys()
    if some:
        yield some


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 for every row of ``items``.

    Equal scores are ranked by ascending doc_id, a null one first; documents of one id are ranked each. Null and empty
    texts of documents and of items have no terms: they are never found, and find nothing. Repeated
    items have their results each; their ranks run on by themselves. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical-search")
    n_docs, n_terms = size = collection_size(docs, text_col)
    index = scratch.save(build_index(docs, size, id_col, text_col), "index", GROUP_BLOCKS)
    out = None
    for number, some in enumerate(_passes(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")))):
        wanted = sorted({t for _, terms in some for t in terms})
        df = document_frequencies(index, wanted)
        weight = {t: math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in wanted}
        place = {t: i for i, t in enumerate(wanted)}
        lists = [(np.array([place[t] for t in terms], np.int64), np.array([weight[t] * n for t, n in terms.items()], np.int64)) for _, terms in some]
        held = spark.sparkContext.broadcast((wanted, lists))

        @tidied("lexical_search")
        def find(batches, held=held) -> Iterator[pa.RecordBatch]:
            wanted, lists = held.value
            wanted = pa.array(wanted, pa.binary())
            best: list[list[tuple]] = [[] for _ in lists]
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "terms"}
                    row["terms"] = batch.column("terms")[i].values.cast(pa.binary())
                    block = Block(row, wanted)
                    for heap, (terms, weights) in zip(best, lists, strict=True):
                        block.visit(terms, weights, heap, top)
            rows = [(i, None if key == math.inf else -key, score) for i, heap in enumerate(best) for score, key in heap]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "doc_id", "score"])

        found = index.mapInArrow(find, "n long, doc_id long, score long")
        best = Window.partitionBy("n").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(some)], f"n long, item_id {dict(items.dtypes)[item_col]}")  # at most PASS_ITEMS rows
        ranked = scratch.save(ranked.join(F.broadcast(names), "n").select("item_id", "rank", "doc_id", "score"), f"found-{number}")
        held.unpersist()
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)[item_col]}, rank int, doc_id long, score long")
    return out
