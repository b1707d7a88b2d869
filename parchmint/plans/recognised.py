"""Documents whose pages were recognised: routing by page, limits, notices, assembly.

Every page takes the first route that applies: past the page cap, past the pixel
budget, embedded text, a recogniser's failure, its text. The two limits end a
document, so no page after them stands. Routing reads page sizes only; words and items
are joined to the pages that need them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.functions.unicode import nfc
from parchmint.operators.gates import page_has_text
from parchmint.operators.layout import assemble_within
from parchmint.operators.ocr import document_confidence, label_low_confidence, ocr_lines, render_ocr_pages, render_scale, within_page_cap, within_pixel_budget
from parchmint.options import OCR_FAILED, OCR_TIMED_OUT, ConvertOptions, Limits
from parchmint.sources.scratch import Scratch

KEYS = ["doc_id", "page_no"]


def route_pages(pages: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows (doc_id, page_no, width, height, scale, route, markdown): route is text, recognise or notice, and markdown a notice."""
    texts = page_has_text(items).where("has_text")
    sizes = pages.select(*KEYS, "width", "height").join(texts, KEYS, "left").withColumn("scale", render_scale(F.col("width"), F.col("height"), limits))
    kept = within_page_cap(sizes.withColumn("markdown", F.lit(None).cast("string")), limits)
    drawn = F.when(F.col("has_text").isNull() & F.col("markdown").isNull(), F.col("width") * F.col("height") * F.col("scale") * F.col("scale")).otherwise(F.lit(0.0))
    kept = within_pixel_budget(kept, drawn, limits)
    route = F.when(F.col("markdown").isNotNull(), "notice").when(F.col("has_text"), "text").otherwise("recognise")
    return kept.select(*KEYS, "width", "height", "scale", route.alias("route"), "markdown")


def recognised_pages(pages: DataFrame, items: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """Rows (doc_id, page_no, markdown, confidence) of the pages that stand.

    ``pages`` has doc_id, page_no, width, height, outcome (ok, timeout, or anything else for a failure),
    text, confidence, canvas_h, lines (line_no, bbox, words) and words, and h_lines and v_lines in page
    units (null: no grid); those of other languages than the options' are left out if it has lang. ``items``
    are the embedded ones (doc_id, page_no, item_idx, str, x, y, height), blank or none for scanned pages.
    """
    from parchmint.plans.convert import items_to_markdown

    options = options or ConvertOptions()
    if "lang" in pages.columns:
        pages = pages.where(F.col("lang") == options.lang)
    scratch = Scratch(pages.sparkSession, "recognised")
    routed = scratch.save(route_pages(pages, items, options.limits), "routed")  # one thin row a page, read by each route
    confidence = F.lit(None).cast("double").alias("confidence")
    notices = routed.where("route = 'notice'").select(*KEYS, "markdown", confidence)

    sized = items.join(routed.where("route = 'text'").select(*KEYS, F.col("width").alias("page_width"), F.col("height").alias("page_height")), KEYS)
    texts = items_to_markdown(sized, options).select(*KEYS, "markdown", confidence)

    # A drawn page stays one row from its route to its text.
    drawn = pages.drop("scale").join(routed.where("route = 'recognise'").select(*KEYS, "scale"), KEYS)
    text = F.coalesce("text", F.lit(""))
    ready = drawn.withColumns({"text": nfc(text) if options.normalize else text, "lines": ocr_lines(F.col("lines"), F.col("canvas_h"), F.col("scale")), "confidence": F.col("confidence").cast("double")})
    shown = render_ocr_pages(ready, ("outcome", "confidence"), options.limits)
    fine = F.coalesce(F.col("outcome") == "ok", F.lit(False))
    late = F.coalesce(F.when(fine, F.col("error") == "timeout").otherwise(F.col("outcome") == "timeout"), F.lit(False))
    lost = F.when(late, F.format_string(OCR_TIMED_OUT, "page_no")).otherwise(F.format_string(OCR_FAILED, "page_no"))
    shown = shown.select(
        *KEYS,
        F.when(fine & F.col("error").isNull(), label_low_confidence(F.col("markdown"), F.col("confidence"))).otherwise(lost).alias("markdown"),
        F.when(fine, F.col("confidence")).alias("confidence"),
    )
    return notices.unionByName(texts).unionByName(shown)


def recognised_documents(pages: DataFrame, items: DataFrame, names: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """Rows (doc_id, markdown, ocr_confidence) for each document of ``names`` (doc_id, sanitized_name)."""
    found = Scratch(pages.sparkSession, "recognised").save(recognised_pages(pages, items, options), "pages")
    return assembled(found, names, (options or ConvertOptions()).limits)


def assembled(found: DataFrame, names: DataFrame, limits: Limits) -> DataFrame:
    """Rows (doc_id, markdown, ocr_confidence) of pages (doc_id, page_no, markdown, confidence), for each document of ``names``."""
    named = names.select("doc_id", "sanitized_name").join(found, "doc_id", "left")
    docs = assemble_within(named, F.col("sanitized_name"), limits.max_output_chars).select("doc_id", "markdown")
    return docs.join(document_confidence(found.where("confidence IS NOT NULL")), "doc_id", "left")
