"""A bounded sample of labelled documents for fitting on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> pa.Table:
    """At most ``rows`` labelled documents (id, text, label), those with the least hashes of their ids.

    Ids with several rows or labels take the greatest text and label. The ids are
    chosen before any text is read; they are at most ``rows`` longs, so they are
    broadcast to the scan of the texts. Texts come whole, so the driver needs room for
    ``rows`` texts of whatever length they have.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    if where is not None:
        marks = marks.where(where)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    present = source.select("id").distinct()
    ids = marks.groupBy("id").agg(F.max("label").alias("label")).join(present, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows).toArrow()
    chosen = docs.sparkSession.createDataFrame(ids)
    texts = source.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
    return texts.select("id", "text", "label").toArrow().sort_by("id")
