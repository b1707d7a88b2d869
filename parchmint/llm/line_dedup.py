"""Removal of lines that stand on many sites.

For every distinct line a HyperLogLog sketch of its sites is merged by
aggregation. A line whose estimated spread is far from the threshold is decided by the
estimate; lines near it get an exact distinct count. A line that stands on
enough sites is boilerplate: its first occurrence, by id and place, stays and
the others go. Lines are known by 128 bits of hash and never shuffled
themselves; a line that a third of all rows share is pre-aggregated.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import bounded_batches, tidied
from parchmint.llm.scratch import Scratch

MIN_SITES = 5
#: log2 of the sketch's slots: about 3 % standard error, and exact for some dozens of sites.
LG_SLOTS = 10
#: Estimates within this factor of the threshold are counted exactly.
NEAR = 2.0


def line_hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(line, F.lit("second"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Of rows (h1, h2, site, id, pos), the hashes with ``min_sites`` distinct sites, and each one's first (id, pos)."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_SLOTS).alias("sketch"), F.count("site").alias("times"), F.min(F.struct("id", "pos")).alias("first"))
    spread = spread.where(F.col("times") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= min_sites / NEAR)
    return spread.select("h1", "h2", "first", "sites", (F.col("sites") <= min_sites * NEAR).alias("near"))


def drop_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the text rebuilt from the lines that stay, and n_lines, n_removed (long) added.

    Lines are what stands between line feeds; lines without a word are never
    removed. A null site is no site. A null text stays null with no lines, and a row
    with a null id is neither counted nor changed. Rows that share an id and a text
    keep the same lines. An empty table gives no rows. Further columns are
    kept as they are; columns named n_lines or n_removed are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    bounded_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    split = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    h1, h2 = line_hashes(F.col("line"))
    lines = split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("id", "site", "pos", h1.alias("h1"), h2.alias("h2"))
    # The lines' hashes are an eighth of the texts; they are read three times.
    lines = scratch.save(lines, "lines")

    found = scratch.save(boilerplate(lines, min_sites), "found")
    near = found.where("near").select("h1", "h2")
    exact = lines.where("site IS NOT NULL").join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    chosen = found.where("NOT near").select("h1", "h2", "first").unionByName(found.where("near").join(exact, ["h1", "h2"]).select("h1", "h2", "first"))
    gone = lines.join(chosen, ["h1", "h2"]).where("NOT (id <=> first.id AND pos <=> first.pos)")
    removed = gone.groupBy("id").agg(F.collect_set(F.struct("pos", "h1")).alias("_removed"))

    kinds = docs.schema
    rest = [f.name for f in kinds]
    joined = docs.join(removed.withColumnRenamed("id", "_id"), docs[id_col] == F.col("_id"), "left").select(*[docs[c] for c in rest], "_removed", F.transform(F.when(F.col("_removed").isNotNull(), F.split(docs[text_col], "\n", -1)), lambda x: F.xxhash64(x)).alias("_h"))
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*kinds, StructField("n_lines", LongType()), StructField("n_removed", LongType())])

    @tidied("line_dedup")
    def rebuild(batches):
        for batch in batches:
            texts, counts, drops = [], [], []
            for text, removed_, hashes in zip(batch.column(text_col).to_pylist(), batch.column("_removed").to_pylist(), batch.column("_h").to_pylist(), strict=True):
                rows = text.split("\n") if text is not None else []
                keep = rows
                if removed_ and rows:
                    out = {(r["pos"], r["h1"]) for r in removed_}
                    keep = [line for i, (line, h) in enumerate(zip(rows, hashes, strict=True)) if (i, h) not in out]
                texts.append(None if text is None else "\n".join(keep))
                counts.append(len(rows))
                drops.append(len(rows) - len(keep))
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], names=[*rest, "n_lines", "n_removed"])

    return joined.mapInArrow(rebuild, schema)
