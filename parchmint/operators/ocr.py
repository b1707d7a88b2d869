"""Pages of recognised words: cleaning, tables and Markdown, and the limits of a run.

Pixel coordinates grow downwards; dividing by the render scale gives page units.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.batches import fields, lists, values
from parchmint.functions.text import INK, WS, all_caps, collapse
from parchmint.operators.deadlines import OutOfTime, within
from parchmint.operators.page_layout import OCR_TABLES, SPACES, Line, Writer, markdown_table, pipe_table, table_regions
from parchmint.options import LOW_CONFIDENCE, OCR_ABORTED, OCR_STOPPED, Limits

_EXHIBIT = re.compile(rf"EXHIBIT[{SPACES}]+[A-Z0-9]", re.I | re.A)
_NUMBER = re.compile(rf"([0-9]{{1,2}}\.)[{SPACES}]+(.*)")
_BULLET = re.compile(rf"[•\-*·][{SPACES}]+(.*)")
_CAPS = re.compile("(?:[^A-Za-z]*[A-Z]){3}[^a-z]*")
#: Neither blank nor a lone bar or bracket.
_WORD = rf"^{WS}*(?:[^|\[\]{WS[1:]}|[|\[\]]{WS}*{INK})"


def good_words(words: Column) -> Column:
    """Words that are not blank, not a lone bar or bracket, and have a confidence of 5 or more."""
    return F.filter(words, lambda w: (w["confidence"] >= 5) & w["text"].rlike(_WORD))


def _placed(words: Column, scale: Column) -> Column:
    """A line's good words (text, x) in page units."""
    return F.transform(good_words(words), lambda w: F.struct(w["text"].alias("text"), (w["bbox"]["x0"] / scale).alias("x")))


def _line(placed: Column, bbox: Column, canvas_h: Column, scale: Column) -> dict[str, Column]:
    """Columns of a line of placed words, in page units."""
    return {
        "words": placed, "text": collapse(F.array_join(F.transform(placed, lambda w: w["text"]), " ")), "xs": F.transform(placed, lambda w: w["x"]),
        "y": (canvas_h - bbox["y0"]) / scale, "y_mid": (bbox["y0"] + bbox["y1"]) / F.lit(2.0) / scale, "h": (bbox["y1"] - bbox["y0"]) / scale,
    }


def _stands(text: Column, y: Column, height: Column) -> Column:
    """Whether a line is neither noise (nothing, or up to four characters that begin with a small letter) nor in the margins; the text is looked at once."""
    return (y > height * F.lit(0.04)) & (y < height * F.lit(0.97)) & text.rlike("(?s)^(?:[^a-z]|.{5})")


def ocr_line_table(lines: DataFrame, canvas_h: Column, scale: Column) -> DataFrame:
    """Lines (bbox, words) in page units; noise and lines in the margins are dropped."""
    out = lines.withColumn("words", _placed(F.col("words"), scale)).withColumns(_line(F.col("words"), F.col("bbox"), canvas_h, scale))
    return out.where(_stands(F.col("text"), F.col("y"), canvas_h / scale))


def ocr_lines(lines: Column, canvas_h: Column, scale: Column) -> Column:
    """The same over a page's array of lines (line_no, bbox, words); null stays null."""
    placed = F.transform(lines, lambda l: F.struct(l["line_no"].alias("line_no"), l["bbox"].alias("bbox"), _placed(l["words"], scale).alias("words")))
    shown = F.transform(placed, lambda l: F.struct(l["line_no"].alias("line_no"), *[c.alias(n) for n, c in _line(l["words"], l["bbox"], canvas_h, scale).items()]))
    return F.filter(shown, lambda l: _stands(l["text"], l["y"], canvas_h / scale))


def no_table_line(text: Column) -> Column:
    """Lines that no table of recognised text holds."""
    return text.rlike(r"^(?i:EXHIBIT)\s+[A-Za-z0-9]") | (all_caps(text) & F.length(text).between(3, 80)) | text.rlike(r"^[0-9]{1,2}\.\s+") | text.rlike(r"^[•\-*·]\s+")


def _caps(text: str) -> bool:
    """Three letters or more, none of them small."""
    return _CAPS.fullmatch(text) is not None


def _barred(line: Line) -> bool:
    t = line.text
    return bool(_EXHIBIT.match(t) or (_caps(t) and 3 <= len(t) <= 80) or _NUMBER.match(t) or _BULLET.match(t))


def ruled_cells(words: Sequence[tuple[str, float, float]], h_lines: list[float], v_lines: list[float]) -> list[list[str]]:
    """Words (text, x, y of the centre) in the cells of a ruled grid; a cell has its upper and left rule, not the others."""
    grid: list[list[list[str]]] = [[[] for _ in v_lines[1:]] for _ in h_lines[1:]]
    for text, x, y in words:
        text = text.strip(SPACES)
        if not text or text in "|[]":
            continue
        row = next((r for r in range(len(h_lines) - 1) if h_lines[r] <= y < h_lines[r + 1]), None)
        col = next((c for c in range(len(v_lines) - 1) if v_lines[c] <= x < v_lines[c + 1]), None)
        if row is not None and col is not None:
            grid[row][col].append(text)
    return [[" ".join(c) or " " for c in row] for row in grid]


def ocr_page_markdown(lines: Sequence[Line], middles: Sequence[float], ruled: tuple[list[list[str]], float, float] | None) -> str:
    """Markdown of a recognised page; a ruled grid (cells, top, bottom) stands at its first line, in place of its lines."""
    barred = {} if ruled else {id(line): _barred(line) for line in lines}  # a line is asked for by each run that is tried
    tables = {} if ruled else {start: (end, columns) for start, end, columns in table_regions(lines, lambda line: barred[id(line)], OCR_TABLES)}
    writer, at, drawn = Writer(), 0, False
    while at < len(lines):
        line = lines[at]
        if ruled and ruled[1] <= middles[at] <= ruled[2]:
            if not drawn:
                writer.block(markdown_table(ruled[0]))
                drawn = True
        elif at in tables:
            end, columns = tables[at]
            writer.block(pipe_table(lines[at:end], columns, OCR_TABLES, merge=False))
            at = end - 1
        elif _EXHIBIT.match(line.text) or (_caps(line.text) and 3 <= len(line.text) <= 60):
            writer.block(f"## {line.text}")
        elif m := _NUMBER.match(line.text):
            writer.item(f"{m[1]} {m[2]}")
        elif m := _BULLET.match(line.text):
            writer.item(f"- {m[1]}")
        elif line.text:
            if writer.chunks and at and abs(lines[at - 1].y - line.y) > line.h * 2.5:
                writer.end_paragraph()
            writer.chunks.append(line.text)
        at += 1
    return writer.text()


def render_ocr_pages(pages: DataFrame, carry: Sequence[str] = (), limits: Limits = Limits()) -> DataFrame:
    """Rows (doc_id, page_no, markdown, error, and the columns to carry) for pages with arrays of lines and words.

    ``pages`` has doc_id, page_no, scale, text, lines (from ``ocr_lines``: line_no, y, y_mid, h, text,
    xs, words), words (text, bbox), and h_lines and v_lines in page units (null: no grid).
    Without any line the page's plain text stands. A page whose time is over has the error ``timeout``. Words without a whole box stand in no cell.
    """
    gridded = F.col("h_lines").isNotNull() & F.col("v_lines").isNotNull()
    source = pages.select("doc_id", "page_no", "scale", "text", "lines", F.when(gridded, F.col("words")).alias("words"), "h_lines", "v_lines", *carry)

    def page_lines(found: pa.Array) -> list[tuple]:
        flat = fields(found, "line_no", "y", "y_mid", "h", "text")
        xs, cells = lists(pc.struct_field(found, ["xs"]), values), lists(pc.struct_field(found, ["words"]), lambda w: fields(w, "x", "text"))
        return [(*line, x, c) for line, x, c in zip(flat, xs, cells, strict=True)]

    def page_words(found: pa.Array) -> list[tuple]:
        boxes = fields(pc.struct_field(found, ["bbox"]), "x0", "x1", "y0", "y1")
        return [(text or "", *box) for text, box in zip(values(pc.struct_field(found, ["text"])), boxes, strict=True)]

    def render(batches):
        for batch in batches:
            out: list[tuple[str | None, str | None]] = []
            rules = [lists(batch.column(c), values) for c in ("h_lines", "v_lines")]
            held = (values(batch.column("scale")), values(batch.column("text")), lists(batch.column("lines"), page_lines), lists(batch.column("words"), page_words), *rules)
            for scale, text, rows, words, across, down in zip(*held, strict=True):
                try:
                    with within(limits.max_ocr_page_ms):
                        rows = sorted(rows or [], key=lambda r: r[0])
                        page = [Line(y, h, shown, xs, cells) for _, y, _, h, shown, xs, cells in rows]
                        ruled = None
                        if across and down and len(across) > 1 and len(down) > 1:
                            s = scale * 2
                            placed = [(word, (x0 + x1) / s, (y0 + y1) / s) for word, x0, x1, y0, y1 in words or [] if None not in (x0, x1, y0, y1)]
                            ruled = (ruled_cells(placed, across, down), across[0], across[-1])
                        out.append((ocr_page_markdown(page, [r[2] for r in rows], ruled) or (text or "").strip(SPACES), None))
                except OutOfTime:
                    out.append((None, "timeout"))
                except Exception as e:  # one page must not end the job
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            kept = ["doc_id", "page_no", *carry]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=[*kept, "markdown", "error"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(render, ", ".join([*(f"{c} {kinds[c]}" for c in ("doc_id", "page_no", *carry)), "markdown string, error string"]))


def confidence_badge(percent: Column) -> Column:
    return F.when(percent >= 85, "conf-high").when(percent >= 75, "conf-medium").when(percent.isNotNull(), "conf-low")


def badge_title(percent: Column) -> Column:
    return F.when(percent >= 85, "Good OCR quality").when(percent >= 75, "Acceptable OCR quality — review complex passages").when(percent.isNotNull(), "Low OCR quality — verify against original document")


def label_low_confidence(markdown: Column, confidence: Column) -> Column:
    """A warning before the text of a page with a confidence under 75."""
    warning = F.format_string(LOW_CONFIDENCE.replace("%s", "%.0f") + "\n\n", confidence)
    return F.when((confidence < 75) & (markdown != ""), F.concat(warning, markdown)).otherwise(markdown)


def document_confidence(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.floor(F.avg("confidence") + F.lit(0.5)).cast("int").alias("ocr_confidence"))


def render_scale(width: Column, height: Column, limits: Limits = Limits()) -> Column:
    """Three, or less where a page would have too many pixels."""
    raw = (width * height).cast("double")
    return F.when(raw * 9 > limits.max_page_pixels, F.sqrt(F.lit(float(limits.max_page_pixels)) / raw)).otherwise(F.lit(3.0))


def within_page_cap(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pages up to the cap, and a notice in place of the first page beyond it."""
    cap = limits.max_ocr_pages
    return pages.where(F.col("page_no") <= cap + 1).withColumn("markdown", F.when(F.col("page_no") > cap, OCR_STOPPED % cap).otherwise(F.col("markdown")))


def within_pixel_budget(pages: DataFrame, pixels: Column, limits: Limits = Limits()) -> DataFrame:
    """Pages before the document's running total of pixels passes the budget, and a notice in place of the one that does."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    total = F.sum(pixels).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = pages.withColumn("total_pixels", total).withColumn("over", F.col("total_pixels") > limits.max_total_pixels)
    out = out.withColumn("_n", F.sum(F.col("over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_n <= 1").drop("_n")
    return out.withColumn("markdown", F.when(F.col("over"), OCR_ABORTED).otherwise(F.col("markdown")))
