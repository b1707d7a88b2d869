"""Conversion options, limits and the status dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Limits:
    """Ceilings of one conversion. The last four archive limits are opt-in guards."""

    max_file_bytes: int = 50 * 1024 * 1024
    max_pages: int = 2000
    soft_pages: int = 500
    max_page_pixels: int = 40_000_000
    max_total_pixels: int = 500_000_000
    max_ocr_pages: int = 100
    max_output_chars: int = 25_000_000
    max_files: int = 50
    max_archive_entries: int = 5000
    max_uncompressed_bytes: int | None = None
    max_entry_bytes: int | None = None
    max_compression_ratio: float | None = None
    max_images: int | None = None
    #: Bytes of one inflated part of a file that a task holds; a larger one is reported as an error.
    max_part_bytes: int = 1 << 27
    max_conversion_ms: int = 60_000
    max_ocr_page_ms: int = 45_000


@dataclass(frozen=True)
class ConvertOptions:
    """A snapshot of the settings for one run; later changes do not reach pages in work."""

    ocr: bool = False
    lang: str = "eng"
    extended: bool = True
    normalize: bool = True
    hyphens: bool = True
    respect_columns: bool = False
    limits: Limits = field(default_factory=Limits)


# The languages offered, prefixes that keep their hyphen, statuses with class, label and spoken label.
LANGUAGES = ("eng", "fra", "deu", "spa", "ita", "por", "nld", "pol", "ces", "vie")
COMPOUND_PREFIXES = (
    "court", "cross", "attorney", "work", "well", "self", "anti", "ex", "non", "pre", "post", "re", "sub", "co", "inter", "intra",
    "over", "under", "out", "up", "down", "all", "half", "mid", "off", "on", "near", "quasi", "ultra", "trans", "bi", "tri",
)
STATUSES = (
    ("queued", "status-queued", "QUEUED", "Queued"),
    ("converting", "status-converting", "CONVERTING…", "Converting"),
    ("ocr", "status-converting", "OCR…", "OCR processing"),
    ("docx", "status-converting", "READING DOCX…", "Reading DOCX document"),
    ("complete", "status-complete", "COMPLETE", "Conversion complete"),
    ("failed", "status-failed", "FAILED", "Conversion failed"),
    ("cancelled", "status-cancelled", "CANCELLED", "Cancelled by user"),
    ("size-exceeded", "status-failed", "EXCEEDS 50 MB", "File exceeds 50 megabyte limit"),
    ("page-exceeded", "status-failed", "EXCEEDS 2000 PAGES", "File exceeds 2000 page limit"),
    ("invalid-pdf", "status-failed", "INVALID PDF", "Not a valid PDF file"),
    ("invalid-format", "status-failed", "UNSUPPORTED FORMAT", "File format not supported"),
    ("invalid-docx", "status-failed", "INVALID DOCX", "Not a valid DOCX file"),
    ("encrypted", "status-failed", "PASSWORD REQUIRED", "PDF is password protected"),
    ("no-text", "status-failed", "NO TEXT — TRY OCR", "No text extracted — enable OCR mode and re-convert"),
)
TRUNCATED = "\n\n[Output truncated — document too large]"
NO_TEXT = "No text could be extracted"
NO_TEXT_BODY = "No text could be extracted from this document. Enable OCR Mode if this is a scanned document."
LOW_CONFIDENCE = (
    "> ⚠️ **Low OCR confidence (%s%%)** — text recognition on this page is unreliable. Common causes: light or faded ink, blurry or low-resolution scan, or significant "
    "page skew. For best results, re-scan at 300+ DPI with high contrast, straight alignment, and dark lines. Review this page against the original document before relying on any extracted text."
)
OCR_STOPPED = "[OCR stopped at page %d — document exceeds maximum OCR page count]"
OCR_TIMED_OUT, OCR_FAILED = "[OCR timed out — page %d]", "[OCR failed — page %d]"
TIMED_OUT = "Conversion timed out — document may be too complex or too large."
LARGE_DOCUMENT = "⚠ large document"
OCR_ABORTED = "[OCR aborted — document has too many large pages]"
CHANGES_WARNING = "> ⚠️ **Tracked changes detected.** This document contains revision marks that may not be fully reflected in the output. Review the original before use."
IMAGES_WARNING = "> 🖼️ **%d image(s) not included.** Embedded images cannot be converted to Markdown."
OTHER_WARNING = "> ℹ️ %s"
#: Messages of the archive gates, in the order in which they are asked.
ARCHIVE_ERRORS = {
    "not_zip": "Not a valid ZIP archive",
    "entries": "Archive has too many entries (%d)",
    "types": "Missing [Content_Types].xml — not a valid Office document",
    "spreadsheet": "XLSX spreadsheets are not supported. Convert to PDF first.",
    "presentation": "PPTX presentations are not supported. Convert to PDF first.",
    "macro": "Macro-enabled documents (DOCM) are not supported.",
    "word": "ZIP file is not a Word document.",
    "document": "Missing word/document.xml — not a valid DOCX.",
}
PDF_ERRORS = {
    "password": "PDF is password-protected.",
    "corrupt": "The file appears to be corrupted or is not a valid PDF.",
    "memory": "The PDF is too large to process.",
    "other": "An error occurred while processing this PDF.",
}


def status_dimension(spark: SparkSession) -> DataFrame:
    """The fourteen statuses: a fixed table, so joins with it broadcast."""
    return spark.createDataFrame(list(STATUSES), "status string, cls string, label string, aria string")
