"""Rows paired with their successor, or with their neighbours, in a global order, with one shuffle of the rows.

Ranges of the order are cut at quantiles of a sample of the keys. Each range goes to
one partition with, as its last row, a copy of the first row of the next range,
so every row meets its successor there and nothing but the shuffle is written.
The cuts decide only where a row is handled, never a result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import PIECE_BYTES, bounded_batches, tidied

Row = dict
#: fn(rows, following): the results of rows, each of which is followed by the row at its place in ``following`` (None: by nothing).
Pairer = Callable[[list[Row], list[Row | None]], list[Row]]
#: Sampled keys for each range.
SAMPLE = 32
#: Rows of a range, about, and the most ranges there are: what the driver holds (a sample of the
#: keys, the keys at the ends of ranges) does not grow with the input beyond these. Larger ranges are sorted on disk and walked as a stream.
RANGE_ROWS, MOST_RANGES = 8192, 8192
#: Runs of like rows that are tried on either side of a row.
REACH = 4


def _key(values: tuple) -> tuple:
    """Comparable as Spark orders: nulls first, strings by their UTF-8 bytes."""
    return tuple((0, 0) if v is None else (1, v.encode() if isinstance(v, str) else v) for v in values)


def _ranges(spark, rows: int) -> int:
    """As many ranges as there are shuffle partitions, and enough for ``RANGE_ROWS`` in each, up to ``MOST_RANGES``."""
    return min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS), 1), MOST_RANGES)


def _cuts(keys: DataFrame, order: list[str]) -> tuple[int, list[tuple]]:
    """The number of ranges, and at most one key less that part the rows about evenly; the driver gets about ``SAMPLE`` keys for each range."""
    rows = keys.count()
    ranges = _ranges(keys.sparkSession, rows)
    share = min(1.0, SAMPLE * ranges / max(rows, 1))
    sample = sorted(_key(tuple(r)) for r in keys.sample(False, share, 7).select(*order).collect())
    return ranges, sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def with_successor(df: DataFrame, order: list[str], text: str, fn: Pairer, schema: str, wrap: bool = False) -> DataFrame:
    """Apply ``fn`` to every row of ``df`` and its successor by ``order``; with ``wrap`` the last row's is the first.

    ``schema`` is that of the results. ``order`` decides every tie by which results
    would differ; null keys come first.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    partitions, cuts = _cuts(df.select(*order), order)
    columns = df.columns
    fields = spark.createDataFrame([], schema).schema

    def assign(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in order), strict=True)
            numbers = pa.array([bisect_right(cuts, _key(k)) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers], names=[*batch.schema.names, "_range"])

    def ranged(part: DataFrame) -> DataFrame:
        return part.mapInArrow(assign, ", ".join([*(f"{c} {t}" for c, t in part.dtypes), "_range int"]))

    # One key for each range, and so one row, is what the driver and the broadcast hold.
    firsts = ranged(df.select(*order)).groupBy("_range").agg(F.min(F.struct(*order)).alias("k")).collect()
    firsts = sorted((r["_range"], tuple(r["k"])) for r in firsts)
    before = [(r, k) for (r, _), (_, k) in zip(firsts, firsts[1:], strict=False)]
    if wrap and firsts:
        before.append((firsts[-1][0], firsts[0][1]))
    kinds = dict(df.dtypes)
    heads = spark.createDataFrame([(r, *k) for r, k in before], ", ".join(["_range int", *(f"_{c} {kinds[c]}" for c in order)]))
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    copies = df.join(F.broadcast(heads), same).select(*columns, "_range", F.lit(1).alias("_copy"))
    dealt = ranged(df).withColumn("_copy", F.lit(0)).unionByName(copies)
    dealt = dealt.repartitionById(partitions, F.col("_range") % partitions).sortWithinPartitions("_range", "_copy", *order)

    @tidied("neighbours")
    def walk(batches) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(fields)
        kept: list[Row] = []
        size = 0

        def results(after: Row | None) -> pa.RecordBatch:
            out = fn(kept, [*kept[1:], after])
            return pa.RecordBatch.from_arrays([pa.array([r[k.name] for r in out], k.type) for k in kinds], schema=kinds)

        for batch in batches:
            for row in batch.to_pylist():
                if row["_copy"]:  # the end of a range; equal first rows are copied alike
                    if kept:
                        yield results(row)
                    kept, size = [], 0
                    continue
                if kept and (kept[-1]["_range"] != row["_range"] or size >= PIECE_BYTES):
                    yield results(row if kept[-1]["_range"] == row["_range"] else None)
                    kept, size = [], 0
                kept.append(row)
                size += 4 * len(row[text] or "")
        if kept:
            yield results(None)

    return dealt.mapInArrow(walk, schema)


def _likeness(content) -> int:
    return int.from_bytes(blake2b(repr(content).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _beside(edges: list[tuple], ahead: bool) -> list[tuple[int, tuple]]:
    """For each range, the keys of the ``REACH`` runs of its last (or first) row's group that stand beyond it."""
    ranges: dict[int, list[tuple]] = {}
    for number, _, key, like in sorted((e for e in edges if e[1] != ahead), key=lambda e: (e[0], _key(e[2]))):
        ranges.setdefault(number, []).append((key, like))  # the heads of ranges if ahead, else their tails
    ends: dict[int, tuple] = {}
    for number, tail, key, like in sorted((e for e in edges if e[1] == ahead), key=lambda e: (e[0], _key(e[2])), reverse=not ahead):
        ends[number] = (key, like)  # the last one stays: the outermost run
    order = sorted(ends, reverse=not ahead)
    out = []
    for i, number in enumerate(order):
        (group, *_), like = ends[number]
        found: list[tuple] = []
        for other in order[i + 1 :]:
            runs = ranges[other] if ahead else ranges[other][::-1]
            for key, its in runs:
                if key[0] != group or len(found) == REACH:
                    break
                if its != like:
                    found.append(key)
                    like = its
            else:
                continue
            break
        out += [(number, k) for k in found]
    return out


def with_neighbours(df: DataFrame, order: list[str], text: str, parse: Callable, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` to every run of like rows and the nearest other runs of its group.

    The group is the first column of ``order``. Rows that follow each other and whose
    ``parse(text)`` is equal are a run. fn(rows, own, before, after) yields the results of
    the run's rows, which have no ``text``; ``before`` and ``after`` hold what was parsed of up
    to ``REACH`` runs on either side, nearest first, wherever the ranges are cut.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    partitions, cuts = _cuts(df.select(*order), order)
    columns = df.columns
    kinds = dict(df.dtypes)
    fields = spark.createDataFrame([], schema).schema
    key_kinds = ", ".join(f"{c} {kinds[c]}" for c in order)

    def numbers(batch) -> pa.Array:
        keys = zip(*(batch.column(c).to_pylist() for c in order), strict=True)
        return pa.array([bisect_right(cuts, _key(k)) for k in keys], pa.int32())

    def assign(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers(batch)], names=[*batch.schema.names, "_range"])

    @tidied("neighbours")
    def liken(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = pa.array([_likeness(parse(t.as_py())) for t in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), numbers(batch), like], names=[*order, "_range", "_like"])

    def edges(batches) -> Iterator[pa.RecordBatch]:
        """The keys of a range's first and last runs."""
        head: list[tuple] = []
        tail: list[tuple] = []
        last = None

        def found() -> pa.RecordBatch:
            rows = [(0, *r) for r in head] + [(1, *r) for r in tail]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=["_tail", *order, "_range", "_like"])

        types = None
        for batch in batches:
            types = [pa.int32(), *batch.schema.types]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (row[-2], row[0], row[-1])
                if now == last:
                    continue
                if last is not None and now[0] != last[0]:
                    yield found()
                    head, tail = [], []
                last = now
                if len(head) <= REACH:
                    head.append(row)
                tail = [*tail[-REACH:], row]
        if head:
            yield found()

    def dealt(part: DataFrame) -> DataFrame:
        return part.repartitionById(partitions, F.col("_range") % partitions).sortWithinPartitions("_range", *order)

    # A few keys for each range are what the driver and the broadcast hold.
    liked = dealt(df.select(*order, text).mapInArrow(liken, f"{key_kinds}, _range int, _like long"))
    ends = [(r["_range"], bool(r["_tail"]), tuple(r[c] for c in order), r["_like"]) for r in liked.mapInArrow(edges, f"_tail int, {key_kinds}, _range int, _like long").collect()]
    wanted = _beside(ends, True) + _beside(ends, False)
    heads = spark.createDataFrame([(r, *k) for r, k in wanted], ", ".join(["_range int", *(f"_{c} {kinds[c]}" for c in order)]))
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    copies = df.join(F.broadcast(heads), same).select(*columns, "_range", F.lit(1).alias("_copy"))
    own = df.mapInArrow(assign, ", ".join([*(f"{c} {t}" for c, t in df.dtypes), "_range int"])).withColumn("_copy", F.lit(0))

    @tidied("neighbours")
    def walk(batches) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(fields)
        runs: list[tuple] = []  # likeness, what was parsed, rows
        at, size = 0, 0  # the first run without results; characters in out
        scope = read = parsed = None
        out: list[Row] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k.name] for r in out], k.type) for k in types], schema=types)

        def settle(ahead: int) -> Iterator[pa.RecordBatch]:
            nonlocal at, size, out
            while len(runs) - at > ahead:
                _, content, rows = runs[at]
                for r in fn(rows, content, [x[1] for x in runs[max(at - REACH, 0) : at][::-1]], [x[1] for x in runs[at + 1 : at + 1 + REACH]]):
                    out.append(r)
                    size += sum(4 * len(v) for v in r.values() if isinstance(v, str))
                    if size >= PIECE_BYTES:
                        yield batch_of()
                        out, size = [], 0
                at += 1
            drop = max(at - REACH, 0)
            del runs[:drop]
            at -= drop

        for batch in batches:
            for row in batch.to_pylist():
                if (row["_range"], row[order[0]]) != scope:
                    yield from settle(0)
                    scope = (row["_range"], row[order[0]])
                    runs.clear()
                    at = 0
                if parsed is None or row[text] != read:
                    read, parsed = row[text], parse(row[text])
                like = _likeness(parsed)
                if not runs or runs[-1][0] != like:
                    runs.append((like, parsed, []))
                if not row.pop("_copy"):
                    del row[text]
                    runs[-1][2].append(row)
                yield from settle(REACH)
        yield from settle(0)
        if out:
            yield batch_of()

    return dealt(own.unionByName(copies)).mapInArrow(walk, schema)
