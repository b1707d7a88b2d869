"""A growing folder of files, converted as they arrive."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from parchmint.options import ConvertOptions
from parchmint.plans.convert import convert_files
from parchmint.streaming.states import capped_stream, timed_store

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


@dataclass
class Batch:
    """What a batch is known to hold and what is done: files and bytes that arrived, pages read, pages written."""

    files: int = 0
    bytes: int = 0
    pages_known: int = 0
    pages_done: int = 0

    def known(self, pages: int) -> None:
        self.pages_known += pages

    def done(self, pages: int) -> None:
        self.pages_done += pages


class FolderProgress(StreamingQueryListener):
    """The progress of a folder's conversion, batch by batch.

    Files and bytes are metrics that the stream's plan observes, told with each batch's progress event;
    pages are observed in the plans of the batch's conversion, while it runs.
    """

    def __init__(self):
        self.batches: dict[int, Batch] = {}

    def batch(self, number: int) -> Batch:
        return self.batches.setdefault(number, Batch())

    def percent(self) -> int:
        """Pages done over pages known, of nine tenths; the last tenth is for the assembly."""
        known = sum(b.pages_known for b in self.batches.values())
        return int(sum(b.pages_done for b in self.batches.values()) / known * 90 + 0.5) if known else 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("arrived")
        if seen is not None and seen["files"]:
            mine = self.batch(event.progress.batchId)
            mine.files, mine.bytes = seen["files"], seen["bytes"] or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def convert_folder(
    spark: SparkSession, source: str, target: str, checkpoint: str, options: ConvertOptions | None = None, per_trigger: int = 1000,
    session: Column | None = None, recognised: DataFrame | None = None, progress: FolderProgress | None = None,
) -> StreamingQuery:
    """Convert all files that are new in ``source`` and append their records to ``target``, then end.

    A batch is written to a folder named by its number, so a batch that runs again after a
    failure replaces what it wrote. With ``session``, an expression over path, modificationTime and length, each upload
    session keeps its first files up to the limit, counted over all batches in the order of their arrival. With
    the option ``ocr`` PDF files go through ``recognised``. The stream lists files and reads no contents; a
    batch reads those of its own files, ``per_trigger`` at most.
    """
    limits = (options or ConvertOptions()).limits
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(source)
    listed = stream.select("path", "modificationTime", "length").observe("arrived", F.count("*").alias("files"), F.sum("length").alias("bytes"))
    if session is not None:
        listed = capped_stream(listed, session, F.unix_micros("modificationTime"), limits)

    def write(batch: DataFrame, number: int) -> None:
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in batch.select("path").collect()]  # per_trigger at most
        files = spark.read.format("binaryFile").schema(SCHEMA).load(paths) if paths else spark.createDataFrame([], SCHEMA)
        told = progress.batch(number) if progress is not None else None
        if told is not None:
            told.pages_known = told.pages_done = 0  # a batch that runs again counts anew
        convert_files(files, options, recognised=recognised, progress=told).write.mode("overwrite").parquet(f"{target}/batch={number}")

    if progress is not None:
        spark.streams.addListener(progress)
    with timed_store(spark):
        return listed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(entries: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of activity entries (ts, msg, level) with the shown time mm:ss.SSS."""
    shown = entries.withColumn("shown", F.date_format("ts", "mm:ss.SSS"))
    return shown.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
