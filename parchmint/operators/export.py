"""Names of exported files, and writers that commit."""

from __future__ import annotations

import io
import json
import os
import zipfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from parchmint.sources import committed
from parchmint.sources.scratch import Scratch


#: Uses of a name from which its numbers are counted in ranges, and the ranges of such a name.
HOT_NAME, RANGES = 1_000_000, 256


def export_names(docs: DataFrame, name: str = "sanitized_name", order: str = "file_ord", batch: list[str] | None = None, hot_name: int = HOT_NAME) -> DataFrame:
    """Adds entry_name: the name with .md, and from its second use on its number in brackets.

    A name with more than ``hot_name`` uses is numbered in ranges of its order, each by itself from what the ranges
    before it hold, so no task sorts them all. Its cuts are quantiles of ``order``, which is a number then; rows that
    tie in it are in one range. Null names are one name of their own, without an entry.
    """
    keys = [*(batch or []), name]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    numeric = dict(docs.dtypes)[order].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    if not numeric:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        return _numbered(docs, name, nth)
    # One row for each hot name: at most one in ``hot_name`` rows.
    hot = docs.groupBy(*keys).agg(F.count("*").alias("_uses")).where(F.col("_uses") > hot_name)
    among = docs.alias("d").join(hot.alias("h"), same("d", "h")).select(*[F.col(f"d.{k}") for k in keys], F.col(f"d.{order}").alias("_o"))
    cuts = among.groupBy(*keys).agg(F.percentile_approx("_o", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    place = F.coalesce(F.size(F.filter(F.array_distinct("c._cuts"), lambda c: c < F.col(f"d.{order}"))), F.lit(0))
    ranged = docs.alias("d").join(cuts.alias("c"), same("d", "c"), "left").select("d.*", F.when(F.col("c._cuts").isNull(), 0).otherwise(place).alias("_range"))
    counts = among.alias("d").join(cuts.alias("c"), same("d", "c")).select(*[F.col(f"d.{k}") for k in keys], F.size(F.filter(F.array_distinct("c._cuts"), lambda c: c < F.col("d._o"))).alias("_range")).groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)))
    joined = local.alias("d").join(before.alias("b"), [*same("d", "b"), F.col("d._range") == F.col("b._range")], "left")
    return _numbered(joined.select("d.*", F.col("b._before")), name, F.col("_k") + F.coalesce("_before", F.lit(0))).drop("_range", "_k", "_before")


def _numbered(docs: DataFrame, name: str, nth) -> DataFrame:
    docs = docs.withColumn("_nth", nth)
    return docs.withColumn("entry_name", F.concat(F.col(name), F.when(F.col("_nth") > 1, F.format_string(" (%d)", F.col("_nth"))).otherwise(""), F.lit(".md"))).drop("_nth")


def zip_archives(docs: DataFrame, batch: str, per_archive: int = 1000) -> DataFrame:
    """Rows (batch, part, archive): zip bytes of entry_name and markdown; a batch of any size is cut into parts.

    A batch has as many parts as its size asks for, and an entry's part comes from its name's hash, so parts hold about
    ``per_archive`` documents and no task sees more than a part. Equal entry names meet in one part, which keeps the later document.
    """
    sizes = docs.groupBy(batch).agg(F.ceil(F.count("*") / per_archive).alias("_parts"))  # one row for each batch
    numbered = docs.alias("d").join(sizes.alias("s"), F.col(f"d.{batch}").eqNullSafe(F.col(f"s.{batch}"))).select("d.*", F.pmod(F.xxhash64("entry_name"), F.col("_parts")).alias("part"))
    kind = dict(docs.dtypes)[batch]

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        entries = {r["entry_name"]: r["markdown"] for r in sorted(table.to_pylist(), key=lambda r: r["file_ord"])}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, text in sorted(entries.items()):
                z.writestr(zipfile.ZipInfo(entry), (text or "").encode())
        return pa.table({batch: pa.array([key[0].as_py()], table.schema.field(batch).type), "part": pa.array([key[1].as_py()], pa.int64()), "archive": pa.array([out.getvalue()], pa.binary())})

    return numbered.select(batch, "part", "file_ord", "entry_name", "markdown").groupBy(batch, "part").applyInArrow(pack, f"{batch} {kind}, part long, archive binary")


class StagedFiles(DataSource):
    """``format("parchmint_files")``: writes (entry_name, file, markdown) as files, one folder for each task's files."""

    @classmethod
    def name(cls) -> str:
        return "parchmint_files"

    def schema(self) -> str:
        return "entry_name string, file string, markdown string"

    def writer(self, schema, overwrite):
        return StagedWriter(self.options["path"], overwrite)


class StagedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, committed.new_job()

    def write(self, iterator):
        folder, own = committed.Folder(self.path), committed.own_name(self.job)
        with folder.create(f"{own}/{_ENTRIES}") as entries:
            for batch in iterator:
                for entry, file, text in zip(*(batch.column(c).to_pylist() for c in ("entry_name", "file", "markdown")), strict=True):
                    data = (text or "").encode()
                    with folder.create(f"{own}/{file}") as out:
                        out.write(data)
                    entries.write(json.dumps([entry, file, len(data)]).encode() + b"\n")
        return committed.Written(TaskContext.get().partitionId(), own)

    def commit(self, messages):
        committed.commit(committed.Folder(self.path), self.job, messages, self.overwrite)

    def abort(self, messages):
        committed.abort(committed.Folder(self.path), self.job)


#: A task's list of its files; no entry has the name, since entries end with .md or are checked.
_ENTRIES = "_entries"


def located(path: str, master: str) -> str:
    """A folder with its file system; a bare path is a local one, which only a local master shares with its tasks."""
    if "://" in path or path.startswith("file:/"):
        return path
    if master == "local" or master.startswith("local["):
        return "file://" + os.path.abspath(path)
    raise ValueError(f"{path!r} names no file system, so every executor would write to its own disk")


def write_markdown(docs: DataFrame, path: str) -> DataFrame:
    """Each document (entry_name, markdown) as a file of its own in the folder ``path``; returns rows (entry_name, bytes) of those written.

    Separators in names become underscores. Two entries of one file name, and names that no file can have, raise
    ``ValueError`` before anything is written. Tasks write into folders of their own attempts beside the target,
    and one manifest names those that count; only then are the files moved to their names, so a killed task or a
    job that fails leaves no file of it in the target. A file of an earlier export is replaced by one of its name.
    """
    spark = docs.sparkSession
    target = located(path, spark.sparkContext.master)
    staging = f"{target.rstrip('/')}/_staging-{committed.new_job()}"
    named = docs.select("entry_name", F.regexp_replace("entry_name", r"[/\\\x00]", "_").alias("file"), "markdown")
    clash = named.groupBy("file").agg(F.count("*").alias("n")).where(f"n > 1 OR file IS NULL OR file IN ('', '.', '..', '{_ENTRIES}')").first()
    if clash is not None:
        raise ValueError(f"{clash['n']} documents would be written to the file {clash['file']!r}")
    spark.dataSource.register(StagedFiles)
    written = Scratch(spark, "files")
    try:
        named.write.format("parchmint_files").mode("append").save(staging)
        folders = [f["name"] for f in committed.committed(committed.Folder(staging))]  # one for each task
        tasks = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(len(folders), 1), "folder")
        return written.save(tasks.mapInArrow(_publisher(target, staging), "entry_name string, bytes long"), "written")
    finally:
        parent = committed.Folder(target)
        parent.remove(staging.rsplit("/", 1)[1])


def _publisher(target: str, staging: str):
    """Moves the files of staged folders to their names; what an attempt before has moved stays moved."""

    def publish(batches):
        source, parent = committed.Folder(staging), committed.Folder(target)
        inside = staging.rsplit("/", 1)[1]
        for batch in batches:
            for own in batch.column("folder").to_pylist():
                with source.open(f"{own}/{_ENTRIES}") as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                there = set(committed.Folder(f"{staging}/{own}").names())
                for _, file, _ in entries:
                    if file in there:
                        parent.move(f"{inside}/{own}/{file}", file)
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in entries], pa.string()), pa.array([e[2] for e in entries], pa.int64())], names=["entry_name", "bytes"])

    return publish
