"""Corpus preparation: documents in, packed windows out, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. ``n_chars`` follows
the text where a stage changes it. The rows of an empty table are none at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.line_dedup import drop_spread_lines
from parchmint.llm.near_dedup import near_duplicates
from parchmint.llm.packing import pack_documents
from parchmint.llm.quality_rules import quality_rules
from parchmint.llm.scratch import Scratch
from parchmint.llm.secrets import masked, secret_spans

_WORD = r"[^\x20\x09-\x0D]"


def _held(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that a stage reads, and all others in one, so that none clashes with a stage's own."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*rest).alias("_rest")] if rest else []))


def _whole(out: DataFrame, docs: DataFrame, rewritten: bool = False) -> DataFrame:
    """The columns of ``docs`` again; n_chars follows a rewritten text."""
    columns = {c: F.col(c) if c in ("doc_id", "text", "source") and c in out.columns else F.col(f"_rest.`{c}`") for c in docs.columns}
    if rewritten and "n_chars" in columns:
        columns["n_chars"] = F.char_length("text").cast("long")
    return out.select(*[c.alias(name) for name, c in columns.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the regression; labels are those of ``labels``.

    Null, empty and blank texts have no words and go. Repeated rows and rows without an id are judged one by one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = _held(docs, "doc_id", "text")
    judged = quality_rules(held, docs, labels, carry=[c for c in held.columns if c != "doc_id"])
    return _whole(judged.where("kept").withColumnRenamed("id", "doc_id"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated lines of many sites; one of which no word is left goes.

    A line's first occurrence, by id and place, stays; rows of one id share it. A text without lines to remove stays as it is, null too.
    """
    out = drop_spread_lines(_held(docs, "doc_id", "text", "source"))
    return _whole(out.where((F.col("n_removed") == 0) | F.col("text").rlike(_WORD)), docs, True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each near-duplicate group: five-word shingles, similarity of 0.8 or more.

    Texts without words and rows without an id are in no group and stay; rows of one id are one document and stay or go together.
    """
    gone = near_duplicates(docs).where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mask; overlapping spans become one. Null texts stay null, no row goes."""
    out = secret_spans(_held(docs, "doc_id", "text")).withColumn("text", masked(F.col("text"), F.col("secret_spans")))
    return _whole(out, docs, True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows, under the public word-end vocabulary; a null text counts as empty, every row is packed."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("secret_scan", secrets), ("packing", packing)]

#: SQL has neither the regression nor the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
