"""Routing and gates of files before anything is parsed, and the states of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.text import format_size, sanitize_filename, truncate
from parchmint.options import ARCHIVE_ERRORS, CHANGES_WARNING, IMAGES_WARNING, LARGE_DOCUMENT, NO_TEXT, OTHER_WARNING, TIMED_OUT, Limits, status_dimension

#: What a reader's warnings about images and about tracked changes hold.
IMAGE, CHANGE = "(?i)image", "(?i)tracked.change|revision"


def sniff(content: Column) -> Column:
    """pdf, zip or null by the first bytes; short contents are neither."""
    return F.when(F.substring(content, 1, 5) == F.unhex(F.lit("255044462D")), "pdf").when(F.substring(content, 1, 4) == F.unhex(F.lit("504B0304")), "zip")


def size_status(size: Column, limits: Limits = Limits()) -> Column:
    return F.when(size > limits.max_file_bytes, "size-exceeded").otherwise("queued")


def page_status(pages: Column, limits: Limits = Limits()) -> Column:
    """Null within the limit."""
    return F.when(pages > limits.max_pages, "page-exceeded")


def soft_warning(pages: Column, limits: Limits = Limits()) -> Column:
    return (pages > limits.soft_pages) & (pages <= limits.max_pages)


def capped(files: DataFrame, order: str, session: list[str], limit: int) -> DataFrame:
    """The first ``limit`` files of each session, with file_ord from 1."""
    w = Window.partitionBy(*session).orderBy(order)
    return files.withColumn("file_ord", F.row_number().over(w)).where(F.col("file_ord") <= limit)


def ingest(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Records of files (path, length, content): safe names, size gate, status."""
    name = F.regexp_extract("path", r"([^/]+)/?\z", 1)
    return files.select(F.sha2("path", 256).alias("id"), name.alias("name"), sanitize_filename(F.regexp_replace(name, r"(?i)\.(pdf|docx)\z", "")).alias("sanitized_name"), F.col("length").alias("size"), size_status(F.col("length"), limits).alias("status"), "content")


def page_has_text(items: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """Rows (keys, has_text): whether any item of a page is not blank."""
    from parchmint.functions.text import INK

    return items.groupBy(*keys).agg(F.bool_or(F.coalesce(F.col("str"), F.lit("")).rlike(INK)).alias("has_text"))


def progress(page: Column, pages: Column) -> Column:
    """Percent after a page; the last tenth is for the assembly."""
    return F.floor(page / pages * 90 + F.lit(0.5))


def clamp_index(index: Column, count: Column) -> Column:
    """The active result after some were removed: the last one where it stood past the end, 0 without any."""
    return F.when(index >= count, F.greatest(count - 1, F.lit(0))).otherwise(index)


def shown_index(index: Column, count: Column) -> Column:
    """The result that is shown: the first where the active one stands past the end; null without any."""
    return F.when(count > 0, F.when(index >= count, F.lit(0)).otherwise(index))


def timed_out(records: DataFrame, elapsed_ms: Column, limits: Limits = Limits()) -> DataFrame:
    """Running records whose time is over fail with the fixed message; others stay as they are."""
    late = F.col("status").isin("converting", "ocr") & (elapsed_ms > limits.max_conversion_ms)
    return records.withColumns({"status": F.when(late, "failed").otherwise(F.col("status")), "error": F.when(late, TIMED_OUT).otherwise(F.col("error"))})


def cancel_or_remove(records: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Chosen running records are cancelled, chosen others go."""
    marked = records.join(chosen.select(key).distinct().withColumn("_chosen", F.lit(True)), key, "left")
    running = F.col("status").isin("converting", "ocr")
    return marked.where(F.col("_chosen").isNull() | running).withColumn("status", F.when(F.col("_chosen"), "cancelled").otherwise(F.col("status"))).drop("_chosen")


def added(records: DataFrame, more: DataFrame) -> DataFrame:
    """Records with others after them; columns go by name, missing ones are null."""
    return records.unionByName(more, allowMissingColumns=True)


def without(records: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Records whose key is not among those of ``gone``."""
    return records.join(gone.select(key), key, "left_anti")


def warning_counts(messages: DataFrame, keys: list[str], message: str = "message") -> DataFrame:
    """How many of the messages tell of images, of tracked changes, and of anything else."""
    m = F.col(message)
    return messages.groupBy(*keys).agg(F.count_if(m.rlike(IMAGE)).alias("images"), F.count_if(m.rlike(CHANGE)).alias("changes"), F.count_if(~m.rlike(IMAGE) & ~m.rlike(CHANGE)).alias("others"))


def archive_error(entries: Column, content_types: Column, limits: Limits = Limits()) -> Column:
    """The first gate that a word-processing archive fails, as its message; null for none."""
    types = F.coalesce(content_types, F.lit(""))
    return (
        F.when(entries.isNull(), ARCHIVE_ERRORS["not_zip"])
        .when(F.size(entries) > limits.max_archive_entries, F.format_string(ARCHIVE_ERRORS["entries"], F.size(entries)))
        .when(content_types.isNull(), ARCHIVE_ERRORS["types"])
        .when(types.contains("spreadsheetml"), ARCHIVE_ERRORS["spreadsheet"])
        .when(types.contains("presentationml"), ARCHIVE_ERRORS["presentation"])
        .when(types.contains("macro") | F.array_contains(entries, "word/vbaProject.bin"), ARCHIVE_ERRORS["macro"])
        .when(~types.contains("wordprocessingml"), ARCHIVE_ERRORS["word"])
        .when(~F.array_contains(entries, "word/document.xml"), ARCHIVE_ERRORS["document"])
    )


def warning_lines(messages: Column) -> Column:
    """The warnings of a reader (type, message) as lines to stand before the text; empty without any."""
    texts = F.transform(F.filter(messages, lambda m: m["type"] == "warning"), lambda m: m["message"])
    image = F.filter(texts, lambda t: t.rlike(IMAGE))
    change = F.filter(texts, lambda t: t.rlike(CHANGE))
    other = F.filter(texts, lambda t: ~t.rlike(IMAGE) & ~t.rlike(CHANGE))
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.when(F.size(change) > 0, F.array(F.lit(CHANGES_WARNING))).otherwise(none),
        F.when(F.size(image) > 0, F.array(F.format_string(IMAGES_WARNING, F.size(image)))).otherwise(none),
        F.transform(other, lambda t: F.format_string(OTHER_WARNING, t)),
    )
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")


def finish(docs: DataFrame, limits: Limits = Limits(), blank_is_no_text: bool = False) -> DataFrame:
    """The tail of a conversion: safe links, length limit, status of documents (markdown)."""
    from parchmint.functions.text import INK, sanitize_links

    done = docs.withColumn("markdown", truncate(sanitize_links(F.col("markdown")), limits.max_output_chars))
    empty = ~F.col("markdown").rlike(INK) if blank_is_no_text else F.col("markdown").contains(NO_TEXT)
    return done.withColumn("status", F.when(empty, "no-text").otherwise("complete"))


def queue_display(records: DataFrame) -> DataFrame:
    """Records with label, class and spoken label of their status and a line of size, pages and a warning; unknown statuses read as queued.

    With ocr_page the label of a page in recognition tells it; with soft_page_warn large documents are marked.
    """
    dim = status_dimension(records.sparkSession)
    known = F.broadcast(dim.select(F.col("status").alias("_s"), "cls", "label", "aria"))
    first = dim.where("status = 'queued'").first()
    out = records.join(known, records["status"] == F.col("_s"), "left").drop("_s")
    out = out.withColumns({c: F.coalesce(c, F.lit(first[c])) for c in ("cls", "label", "aria")})
    if "ocr_page" in records.columns:
        of = F.concat(F.lit("OCR · PAGE "), F.col("ocr_page").cast("string"), F.lit(" OF "), F.when(F.col("pages") > 0, F.col("pages").cast("string")).otherwise("?"))
        out = out.withColumn("label", F.when((F.col("status") == "ocr") & F.col("ocr_page").isNotNull(), of).otherwise(F.col("label")))
    pages = F.when(F.col("pages") > 0, F.concat(F.col("pages").cast("string"), F.lit(" pages")))
    large = F.when(F.col("soft_page_warn"), LARGE_DOCUMENT) if "soft_page_warn" in records.columns else F.lit(None)
    return out.withColumn("detail", F.concat_ws(" · ", format_size(F.col("size")), pages, large))


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"))


def batch_flags(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and quantified states of each batch."""
    s = F.col("status")
    return records.groupBy(*keys).agg(
        F.count_if(s == "complete").alias("complete"), F.count_if(s == "queued").alias("queued"),
        F.bool_and(s.isin("complete", "failed", "cancelled")).alias("all_done"), F.bool_or(s.isin("converting", "ocr", "docx")).alias("any_running"),
    )


def requeue(records: DataFrame) -> DataFrame:
    """Once recognition is switched on, documents without text are queued again."""
    return records.withColumn("status", F.when(F.col("status") == "no-text", "queued").otherwise(F.col("status")))
