"""A conversion that runs beside its caller: its progress can be read, and it can be cancelled."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.operators.gates import cancel_or_remove
from parchmint.plans.convert import RECORD, convert_files
from parchmint.sources.scratch import remove

#: Fixed value: the share of the progress that pages make up; the rest is for the assembly.
PAGE_PERCENT = 90


class Conversion:
    """Writes the records of files to ``target`` as Parquet.

    ``status`` is queued, converting, complete, failed or cancelled. Every Spark job of the run carries
    the run's own tag, so ``cancel`` stops its tasks and no others; what they had written is removed, and the
    records of the run are then those of ``cancelled_records``. ``progress`` is a percentage: pages done over
    pages known, as the plan itself counts them, and 100 once all is written.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, target: str, convert: Callable[..., DataFrame] = convert_files, **options):
        self.spark, self.files, self.target, self.convert, self.options = spark, files, target, convert, options
        self.tag = f"conversion-{uuid.uuid4().hex}"
        self.status = "queued"
        self.error: Exception | None = None
        self.pages_known = self.pages_done = 0
        self.thread = InheritableThread(target=self._run, session=spark)

    def start(self) -> Conversion:
        self.status = "converting"
        self.thread.start()
        return self

    def _run(self) -> None:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.setInterruptOnCancel(True)
        try:
            records = self.convert(self.files, progress=self, **self.options)
            records.write.mode("errorifexists").parquet(self.target)
            if self.status == "converting":
                self.pages_done = self.pages_known
                self.status = "complete"
        except Exception as e:  # told to whoever waits
            if self.status != "cancelled":
                self.status, self.error = "failed", e
        finally:
            context.removeJobTag(self.tag)
            if self.status != "complete":
                remove(self.spark, self.target)

    def known(self, pages: int) -> None:
        self.pages_known += pages

    def done(self, pages: int) -> None:
        self.pages_done += pages

    def progress(self) -> int:
        if self.status == "complete":
            return 100
        return int(self.pages_done / self.pages_known * PAGE_PERCENT + 0.5) if self.pages_known else 0

    def cancel(self) -> None:
        """Stop the run's tasks and wait until nothing of it is left; a run that has ended stays as it is."""
        if self.status in ("queued", "converting"):
            self.status = "cancelled"
            while self.thread.is_alive():
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
                self.thread.join(0.2)  # a job that starts between two calls is met by the next

    def wait(self, seconds: float | None = None) -> str:
        """The status after the run, or after so many seconds; raises what made it fail."""
        self.thread.join(seconds)
        if self.error is not None:
            raise self.error
        return self.status

    def records(self) -> DataFrame:
        """The run's records: what was written, or every file in the state that the cancellation left it in."""
        if self.status == "complete":
            return self.spark.read.parquet(self.target)
        return cancelled_records(self.files, self.options.get("options"))


def cancelled_records(files: DataFrame, options=None) -> DataFrame:
    """Records of files whose conversion was cancelled: those that a gate had refused keep its status."""
    from parchmint.operators.gates import ingest
    from parchmint.options import ConvertOptions

    records = ingest(files, (options or ConvertOptions()).limits).drop("content")
    running = records.withColumn("status", F.when(F.col("status") == "queued", "converting").otherwise(F.col("status")))
    out = cancel_or_remove(running, running.where("status = 'converting'"), "id")
    null = {"error": F.lit(None).cast("string"), "pages": F.lit(None).cast("int"), "soft_page_warn": F.lit(False), "ocr_confidence": F.lit(None).cast("int"), "markdown": F.lit(None).cast("string")}
    return out.withColumns(null).select(*RECORD)
