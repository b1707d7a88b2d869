"""Registered queries of the operators that keep state in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.options import TIMED_OUT, Limits
from parchmint.plans.queries import lit, query
from parchmint.sources.scratch import Scratch
from parchmint.streaming.states import capped_stream, file_states, final_states, timed_store

#: How long work may take in the query over ``events``, where events of one user lie hours apart.
_LIMIT = Limits(max_conversion_ms=12 * 3600 * 1000)
_KIND = """CASE WHEN event_type = 'signup' THEN 'add' WHEN event_type = 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'requeue' ELSE 'start' END
    WHEN event_type = 'click' THEN 'recognise' WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'no-text' ELSE 'complete' END
    WHEN event_id % 2 = 0 THEN 'fail' ELSE 'cancel' END"""


def run_to_end(spark: SparkSession, stream: DataFrame, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now into a table of the shared folder, and read that."""
    with timed_store(spark):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{scratch.root}/{name}").option("checkpointLocation", f"{scratch.root}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{scratch.root}/{name}")


def as_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether it is one file or a folder: a pattern may name either, a plain path only a folder."""
    known = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(known).parquet(f"{sf_dir}/{name}.parque[t]")


@query(
    "stream_file_states",
    f"""
    WITH RECURSIVE ev AS (
        SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events
    ), state AS (
        SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::VARCHAR AS status, 0::BIGINT AS since, 0::BIGINT AS at_ms, NULL::VARCHAR AS error FROM ev
        UNION ALL
        SELECT user_id, k, then_, CASE WHEN then_ = 'converting' AND was <> 'converting' THEN ms ELSE since END,
               CASE WHEN moved THEN ms WHEN late THEN since + {_LIMIT.max_conversion_ms} ELSE at_ms END,
               CASE WHEN moved THEN NULL WHEN late THEN {lit(TIMED_OUT)} ELSE error END
        FROM (
            SELECT *, then_ IS DISTINCT FROM was AS moved FROM (
                SELECT *, CASE
                    WHEN kind = 'cancel' AND was IN ('converting', 'ocr') THEN 'cancelled'
                    WHEN kind = 'cancel' THEN NULL
                    WHEN kind = 'add' AND was IS NULL THEN 'queued'
                    WHEN kind = 'start' AND was = 'queued' THEN 'converting'
                    WHEN kind = 'recognise' AND was = 'converting' THEN 'ocr'
                    WHEN kind = 'requeue' AND was = 'no-text' THEN 'queued'
                    WHEN kind IN ('complete', 'no-text') AND was IN ('converting', 'ocr') THEN kind
                    WHEN kind = 'fail' AND was IN ('converting', 'ocr') THEN 'failed'
                    ELSE was END AS then_
                FROM (
                    SELECT s.user_id, e.k, e.ms, e.kind, s.since, s.at_ms, s.error,
                           s.status IN ('converting', 'ocr') AND e.ms >= s.since + {_LIMIT.max_conversion_ms} AS late,
                           CASE WHEN s.status IN ('converting', 'ocr') AND e.ms >= s.since + {_LIMIT.max_conversion_ms} THEN 'failed' ELSE s.status END AS was
                    FROM state s JOIN ev e ON e.user_id = s.user_id AND e.k = s.k + 1)))
    ), ends AS (SELECT user_id, max(k) AS k FROM ev GROUP BY user_id), now AS (SELECT max(ms) AS ms FROM ev),
    last AS (SELECT s.*, s.status IN ('converting', 'ocr') AND s.since + {_LIMIT.max_conversion_ms} <= now.ms AS late FROM state s JOIN ends USING (user_id, k), now)
    SELECT user_id, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN since + {_LIMIT.max_conversion_ms} ELSE at_ms END AS at_ms,
           CASE WHEN late THEN {lit(TIMED_OUT)} ELSE error END AS error
    FROM last WHERE status IS NOT NULL
    """,
)
def stream_file_states(spark, d):
    found = as_stream(spark, d, "events")
    at_ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    events = found.select(
        F.col("user_id").cast("string").alias("id"), F.timestamp_millis(at_ms).alias("at"), F.col("event_id").alias("seq"), F.expr(_KIND).alias("event"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("pages"), F.lit(None).cast("string").alias("error"),
    )
    records = run_to_end(spark, file_states(events, _LIMIT), Scratch(spark, "file-states"), "records")
    return final_states(records).select(F.col("id").cast("long").alias("user_id"), "status", "at_ms", "error")


@query("stream_session_cap", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS file_ord FROM documents QUALIFY file_ord <= 50")
def stream_session_cap(spark, d):
    files = as_stream(spark, d, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("path"))
    taken = run_to_end(spark, capped_stream(files, F.col("source"), F.col("doc_id")), Scratch(spark, "session-cap"), "taken")
    return taken.select(F.col("session").alias("source"), F.col("path").cast("long").alias("doc_id"), "file_ord")
