"""From file bytes to Markdown records: routing, the two readers, and the common tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parchmint.functions.text import classify_error
from parchmint.functions.unicode import nfc
from parchmint.operators.gates import archive_error, capped, finish, ingest, page_status, sniff, soft_warning, warning_lines
from parchmint.operators.html_blocks import blocks_to_markdown
from parchmint.operators.layout import assemble_within, printable
from parchmint.operators.page_layout import lines_of_items, render_pages
from parchmint.options import NO_TEXT_BODY, TIMED_OUT, ConvertOptions
from parchmint.plans.recognised import assembled, recognised_pages
from parchmint.sources.docx import read_docx
from parchmint.sources.files import zip_directory
from parchmint.sources.pdf import read_pdfs
from parchmint.sources.scratch import Scratch


def items_to_markdown(items: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """Page Markdown (doc_id, page_no, markdown, error) of items with page_width and page_height."""
    options = options or ConvertOptions()
    shown = printable(items)
    if options.normalize:
        shown = shown.withColumn("str", nfc("str"))
    return render_pages(lines_of_items(shown, options), options)


RECORD = ("id", "name", "sanitized_name", "size", "status", "error", "pages", "soft_page_warn", "ocr_confidence", "markdown")


def _nulls(*but: str) -> dict:
    """The columns of a record that hold nothing yet."""
    kinds = {"error": "string", "pages": "int", "ocr_confidence": "int", "markdown": "string"}
    return {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in but} | ({} if "soft_page_warn" in but else {"soft_page_warn": F.lit(False)})


def convert_files(
    files: DataFrame, options: ConvertOptions | None = None, styles: bool = False, recognised: DataFrame | None = None, session: list[str] | None = None, progress=None
) -> DataFrame:
    """Records of files (path, length, content): status, error and Markdown.

    Files that fail a gate never reach a reader, and each reader runs once: what it finds is written to the shared
    folder, and all else starts from there. With ``session``, columns that tell upload sessions apart, each keeps its
    first ``max_files`` by path. With the option ``ocr`` PDF files go by pages through ``recognised`` (what
    ``recognised_pages`` reads, keyed by path in place of doc_id), which must be given then. ``progress`` is told of
    pages as the plan counts them: ``known(n)`` once they are read, ``done(n)`` once their text is written.
    """
    options = options or ConvertOptions()
    limits = options.limits
    if options.ocr and recognised is None:
        raise ValueError("the option ocr needs the table of recognised pages")
    scratch = Scratch(files.sparkSession, "convert")
    if session:
        first = capped(files.select("path", *session), "path", session, limits.max_files)
        files = files.join(first.select("path"), "path", "left_semi")
    records = ingest(files, limits).withColumn("kind", F.when(F.col("status") == "queued", F.coalesce(sniff(F.col("content")), F.lit("none"))))
    heads = scratch.save(records.drop("content"), "records")
    refused = heads.where("kind IS NULL OR kind = 'none'").withColumns(_nulls()).withColumn("status", F.when(F.col("kind") == "none", "invalid-format").otherwise(F.col("status")))
    words = _word_records(records.where("kind = 'zip'"), heads.where("kind = 'zip'"), limits, styles, scratch)
    return refused.select(*RECORD).unionByName(words).unionByName(_pdf_records(records.where("kind = 'pdf'"), heads.where("kind = 'pdf'"), options, recognised, scratch, progress))


def _word_records(files: DataFrame, heads: DataFrame, limits, styles: bool, scratch: Scratch) -> DataFrame:
    """Records of archives: gates, then the text of those that pass."""
    parts = zip_directory(files, limit=limits.max_part_bytes).withColumnRenamed("error", "_zip_error")
    gate = F.when(F.col("entries").isNotNull() & F.col("_zip_error").isNotNull(), F.col("_zip_error")).otherwise(archive_error(F.col("entries"), F.col("content_types"), limits))
    for column, bound in (("uncompressed", limits.max_uncompressed_bytes), ("largest", limits.max_entry_bytes), ("images", limits.max_images)):
        if bound is not None:
            gate = F.coalesce(gate, F.when(F.col(column) > bound, F.lit(f"Archive exceeds the limit of {column}")))
    parts = scratch.save(parts.withColumn("gate", gate), "archives")
    if limits.max_compression_ratio is not None:
        sized = parts.join(heads.select("id", "size"), "id")
        parts = sized.withColumn("gate", F.coalesce("gate", F.when(F.col("uncompressed") > F.col("size") * limits.max_compression_ratio, F.lit("Archive exceeds the limit of compression")))).drop("size")
    rejected = parts.where("gate IS NOT NULL").select("id", F.lit(None).cast("string").alias("markdown"), F.lit("invalid-docx").alias("status"), F.col("gate").alias("error"))
    read = scratch.save(read_docx(parts.where("gate IS NULL"), styles=styles).withColumn("_before", warning_lines(F.coalesce("messages", F.array().cast("array<struct<type:string,message:string>>")))), "word")
    text = read.select("id", "_before", "error").join(blocks_to_markdown(read, "id"), "id")
    done = finish(text.withColumn("markdown", F.concat("_before", F.coalesce("markdown", F.lit("")))), limits, blank_is_no_text=True)
    failed = F.col("error").isNotNull()
    done = done.select("id", F.when(~failed, F.col("markdown")).alias("markdown"), F.when(failed, "failed").otherwise(F.col("status")).alias("status"), "error")
    return heads.drop("status").join(done.unionByName(rejected), "id").withColumns(_nulls("error", "markdown")).select(*RECORD)


def _pdf_records(files: DataFrame, heads: DataFrame, options: ConvertOptions, recognised: DataFrame | None, scratch: Scratch, progress) -> DataFrame:
    """Records of PDF files: gates by pages, then the text of their pages."""
    limits = options.limits
    heads = heads.drop("status", "kind")
    status = F.when(F.col("error_name") == "PasswordException", "encrypted").when(F.col("error").isNotNull(), "failed").otherwise(page_status(F.col("n"), limits))
    read = read_pdfs(files, limit=limits.max_part_bytes, max_ms=limits.max_conversion_ms).withColumn("n", F.size("pages"))
    counted = Observation()
    judged = scratch.save(read.withColumn("status", status).observe(counted, F.coalesce(F.sum(F.when(F.col("status").isNull(), F.col("n"))), F.lit(0)).alias("pages")), "pdf")
    if progress is not None:
        progress.known(counted.get["pages"])
    told = F.when(F.col("error").contains("over the limit") | (F.col("error_name") == "TimeoutException"), F.col("error")).otherwise(classify_error(F.col("error"), F.col("error_name")))
    refused = judged.where("status IS NOT NULL").select("id", "status", F.when(F.col("status") == "failed", told).alias("error"))
    out = heads.join(refused, "id").withColumns(_nulls("error")).select(*RECORD)

    fine = judged.where("status IS NULL")
    sizes = fine.select("id", "n", F.size("items").alias("n_items"), soft_warning(F.col("n"), limits).alias("soft_page_warn"))
    known = heads.join(sizes, "id")
    names = heads.select(F.col("id").alias("doc_id"), "sanitized_name")
    geometry = fine.select(F.col("id").alias("doc_id"), F.explode("pages").alias("p")).select("doc_id", "p.page_no", F.col("p.width").alias("page_width"), F.col("p.height").alias("page_height"))
    items = fine.select(F.col("id").alias("doc_id"), F.explode("items").alias("i")).select("doc_id", "i.*")
    if options.ocr:
        seen = recognised.withColumn("doc_id", F.sha2("path", 256)).drop("path", "width", "height")
        if "lang" in seen.columns:
            seen = seen.where(F.col("lang") == options.lang).drop("lang")
        drawn = geometry.withColumnsRenamed({"page_width": "width", "page_height": "height"}).join(seen, ["doc_id", "page_no"], "left")
        pages = recognised_pages(drawn, items, options)
    else:
        pages = items_to_markdown(items.join(geometry, ["doc_id", "page_no"]), options)
    counted = Observation()
    pages = scratch.save(pages.observe(counted, F.count("*").alias("pages")), "pages")
    if progress is not None:
        progress.done(counted.get["pages"])
    if options.ocr:
        docs = assembled(pages, names.join(fine.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), limits).withColumnRenamed("doc_id", "id")
        whole = known.join(docs, "id")
    else:
        late = pages.where(F.col("error") == TIMED_OUT).select(F.col("doc_id").alias("id"), F.lit(True).alias("_late")).distinct()
        docs = assemble_within(pages.join(names, "doc_id"), F.col("sanitized_name"), limits.max_output_chars).select(F.col("doc_id").alias("id"), F.col("markdown").alias("_md"))
        title = F.concat(F.lit("# "), F.col("sanitized_name"))
        whole = known.join(docs, "id", "left").withColumn("markdown", F.when(F.col("n_items") == 0, F.concat(title, F.lit("\n\n" + NO_TEXT_BODY))).otherwise(F.coalesce("_md", title)))
        whole = whole.withColumn("ocr_confidence", F.lit(None).cast("int")).join(late, "id", "left")
    whole = finish(whole, limits).withColumn("pages", F.col("n")).withColumn("error", F.lit(None).cast("string"))
    if not options.ocr:  # a page that used up the document's time ends the document
        whole = whole.withColumns({"status": F.when(F.col("_late"), "failed").otherwise(F.col("status")), "error": F.when(F.col("_late"), F.lit(TIMED_OUT)), "markdown": F.when(F.col("_late").isNull(), F.col("markdown"))})
    return out.unionByName(whole.select(*RECORD))
