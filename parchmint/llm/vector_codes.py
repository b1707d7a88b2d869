"""Product codes of vectors: integer codebooks, trained in rounds and searched through kd-trees.

A vector's components become integers, so sums over any partition of the rows are exact and
codes do not depend on how rows are dealt. Each round sends one kd-tree for each part
to the executors; a task assigns its rows and adds them up by entry before anything is
shuffled, so a round shuffles at most entries x parts rows for each task and the driver
gets as many in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import bounded_batches, tidied
from parchmint.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf of a tree.
LEAF = 8
#: The largest size of an integer component: squares of differences then add up within 64 bits.
LARGEST = 1 << 26
#: Rows that are searched at once.
SLICE = 1 << 13


class Tree:
    """A kd-tree over integer entries; ``nearest`` gives the least index among the nearest ones.

    A node holds its entries' bounding box. The squared distance to a box bounds those to
    its entries from below; a box whose bound equals the best distance so far is still
    visited, as an entry of a lower index may lie at that same distance.
    """

    def __init__(self, entries: np.ndarray, numbers: np.ndarray | None = None):
        numbers = np.arange(len(entries)) if numbers is None else numbers
        self.low, self.high = entries.min(axis=0), entries.max(axis=0)
        self.below: tuple[Tree, Tree] | None = None
        axis = int((self.high - self.low).argmax()) if entries.size else 0
        if len(entries) <= LEAF or not entries.size or self.low[axis] == self.high[axis]:
            self.entries, self.numbers = entries, numbers
            return
        order = np.argsort(entries[:, axis], kind="stable")
        half = len(order) // 2
        self.below = tuple(Tree(entries[some], numbers[some]) for some in (np.sort(order[:half]), np.sort(order[half:])))

    def bounds(self, points: np.ndarray) -> np.ndarray:
        away = np.maximum(np.maximum(self.low - points, points - self.high), 0)
        return np.einsum("ij,ij->i", away, away)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's entry and its squared distance: all points see their nearest leaf first, then whatever the bounds leave open."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        found = np.full(len(points), np.iinfo(np.int64).max)
        self._descend(points, np.arange(len(points)), best, found)
        self._visit(points, np.arange(len(points)), best, found)
        return found, best

    def _descend(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        if self.below is None:
            return self._compare(points, rows, best, found)
        one, two = (child.bounds(points[rows]) for child in self.below)
        for child, some in zip(self.below, (one <= two, one > two), strict=True):
            if some.any():
                child._descend(points, rows[some], best, found)

    def _visit(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """Compare the points whose bound is at most their best distance so far."""
        rows = rows[self.bounds(points[rows]) <= best[rows]]
        if not len(rows):
            return
        if self.below is None:
            return self._compare(points, rows, best, found)
        for child in self.below:
            child._visit(points, rows, best, found)

    def _compare(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        away = points[rows][:, None, :] - self.entries
        distances = np.einsum("ijk,ijk->ij", away, away)
        nearest = distances.argmin(axis=1)  # the first of equal ones, and a leaf's numbers ascend
        distance, number = distances[np.arange(len(rows)), nearest], self.numbers[nearest]
        better = (distance < best[rows]) | ((distance == best[rows]) & (number < found[rows]))
        best[rows[better]], found[rows[better]] = distance[better], number[better]


def integers(vectors: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vectors`` with ``_v``, the integer components of whole vectors; others are dropped.

    Dropped are null and empty vectors and those with a component that is null, NaN or infinite.
    """
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(whole).withColumn("_v", F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), width)


def _slices(batches, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            yield some, _matrix(some.column("_v"), width)


def codebooks(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Integer entries by part after all rounds; ``kept`` has (id, _v), vectors of ``width`` components.

    The entries start as the parts of the first ``entries`` vectors by id (null ids last, equal ids by components). In
    a round every part goes to its nearest entry, the lower index on ties, and an entry becomes
    the componentwise floor(sum / count) of its parts; one without parts stays.
    """
    first = kept.orderBy(F.col("id").asc_nulls_last(), "_v").limit(entries).collect()
    size = width // parts
    books = np.array([r["_v"] for r in first], np.int64).reshape(len(first), parts, size).transpose(1, 0, 2)
    bounded_batches(kept.sparkSession)
    for _ in range(rounds):
        trees = kept.sparkSession.sparkContext.broadcast([Tree(book) for book in books])

        @tidied("vector_codes")
        def add_up(batches) -> Iterator[pa.RecordBatch]:
            count = np.zeros((parts, len(first)), np.int64)
            total = np.zeros((parts, len(first), size), np.int64)
            for _, whole in _slices(batches, width):
                for p, tree in enumerate(trees.value):
                    mine = whole[:, p * size : (p + 1) * size]
                    nearest, _ = tree.nearest(mine)
                    order = np.argsort(nearest, kind="stable")
                    used, at = np.unique(nearest[order], return_index=True)
                    count[p] += np.bincount(nearest, minlength=len(first))
                    total[p, used] += np.add.reduceat(mine[order], at, axis=0)
            part, entry = np.nonzero(count)
            sums = total[part, entry]
            at = pa.array(np.arange(len(part) + 1) * size, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.ListArray.from_arrays(at, pa.array(sums.reshape(-1)))],
                names=["part", "entry", "n", "sums"],
            )

        partial = kept.select("_v").mapInArrow(add_up, "part int, entry int, n long, sums array<long>")
        # Sums of long running could leave 64 bits over many tasks, hence decimals.
        added = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
        rows = partial.groupBy("part", "entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *added).collect()  # parts x entries at most
        books = books.copy()
        for r in rows:
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(size)]
        trees.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Rows (id, label, code, error, label_error, codebooks_sha256), one for each whole vector.

    ``code`` has two hexadecimal digits for each part, so ``entries`` is at most 256. label_error is the sum of error
    over rows of an equal label, nulls together. Null and empty vectors and those
    with a null or non-finite component are dropped, as are vectors of another length than
    the first one by id (null ids last); repeated rows are coded each. With fewer than
    ``entries`` vectors all of them are entries. An empty table gives no rows.
    The length must be a multiple of ``parts``, and no integer component may exceed 2**26 in size.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code's two digits number 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    kept = integers(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), "v", scale).drop("v")
    kept = scratch.save(kept.withColumn("_top", F.array_max(F.transform("_v", lambda x: F.abs(x)))), "kept")
    head = kept.orderBy(F.col("id").asc_nulls_last(), "_v").select(F.size("_v").alias("n")).first()
    width = head["n"] if head else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components are not cut into {parts} equal parts")
    if kept.where((F.size("_v") == width) & (F.col("_top") > LARGEST)).limit(1).count():
        raise ArithmeticError(f"a component is beyond {LARGEST / scale} in size")
    kept = kept.where(F.size("_v") == width).drop("_top")
    books = codebooks(kept.select("id", "_v"), width, parts, entries, rounds) if head else np.zeros((parts, 0, 1), np.int64)
    trees = vectors.sparkSession.sparkContext.broadcast([Tree(book) for book in books] if head else [])
    size = width // parts

    @tidied("vector_codes")
    def encode(batches) -> Iterator[pa.RecordBatch]:
        for batch, whole in _slices(batches, width):
            code, error = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
            for p, tree in enumerate(trees.value):
                nearest, distance = tree.nearest(whole[:, p * size : (p + 1) * size])
                code[:, p] = nearest
                error += distance
            text = code.tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    kind = dict(kept.dtypes)["label"]
    coded = scratch.save(kept.mapInArrow(encode, f"id long, label {kind}, code string, error long"), "codes")
    # One row for each label, written so that the planner knows its size and broadcasts it only where it is small.
    sums = scratch.save(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
