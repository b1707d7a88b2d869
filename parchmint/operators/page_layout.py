"""Sequential layout of one page: table regions, merged headings, repaired hyphens, Markdown.

These steps carry state from line to line, so they run in Python on the lines of
one page at a time; everything before them is relational. A page that fails
yields an error instead of ending the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.functions.batches import bounded_batches, fields, lists, values
from parchmint.functions.text import heading_level
from parchmint.operators.deadlines import OutOfTime, within
from parchmint.operators.layout import PAGE, line_table, number_lines, reading_order, with_modal_height
from parchmint.options import COMPOUND_PREFIXES, TIMED_OUT, ConvertOptions

SPACES = "\t\n\x0b\x0c\r                  　﻿"
_SPACE_RUN = re.compile(f"[{SPACES}]+")
_BULLET = re.compile(rf"[•\-*·○–][{SPACES}]+(.*)\Z")
_NUMBER = re.compile(rf"(?:[0-9]+\.|\([A-Za-z0-9]+\))[{SPACES}]+(.*)\Z")
_HYPHEN = re.compile(r"[A-Za-z]-\Z")


def squeeze(text: str) -> str:
    return _SPACE_RUN.sub(" ", text).strip(SPACES)


@dataclass
class Line:
    y: float
    h: float
    text: str
    xs: list[float]
    cells: list[tuple[float, str]]
    level: int = 0
    marker: str | None = None
    marked: str = ""


@dataclass(frozen=True)
class TableRules:
    """What makes neighbouring lines a table: distances in points, and limits of the columns."""

    cluster: float
    touch: float
    gap: float
    fill: float | None  # two rows must touch two columns within this; None: no such rule
    assign: float
    most_columns: int | None = None


TEXT_TABLES = TableRules(cluster=14, touch=16, gap=40, fill=18, assign=18)
OCR_TABLES = TableRules(cluster=20, touch=20, gap=28, fill=None, assign=20, most_columns=4)


def _clusters(places: Iterable[float], counts: Iterable[int], tolerance: float) -> Iterator[tuple[float, int]]:
    """Clusters of ascending numbers that stand at so many places each, as they end; like numbers are never parted."""
    total, size = 0.0, 0
    for x, n in zip(places, counts, strict=False):
        if n:
            if size and not x - total / size <= tolerance:
                yield total / size, size
                total, size = 0.0, 0
            for _ in range(n):  # one after the other, as the sum's last bits depend on it
                total += x
            size += n
    if size:
        yield total / size, size


def anchors(xs: Sequence[float], tolerance: float) -> list[tuple[float, int]]:
    """Means and sizes of the clusters of ascending numbers, each within the tolerance of the open cluster's mean."""
    return list(_clusters(xs, repeat(1), tolerance))


def _touches(xs: Sequence[float], column: float, reach: float) -> bool:
    return any(abs(x - column) <= reach for x in xs)


def _goes_on(xs: Sequence[float], clusters: Iterable[tuple[float, int]], reach: float) -> bool:
    """Whether two clusters have two members, and one of these is touched; no more clusters are made than that takes."""
    shared, touched = 0, False
    for c, n in clusters:
        if n >= 2:
            shared, touched = shared + 1, touched or _touches(xs, c, reach)
            if shared >= 2 and touched:
                return True
    return False


def _columns(clusters: Iterable[tuple[float, int]], height: int, rules: TableRules) -> list[float]:
    """The columns of a run of lines; none where they are too few, too many or too near, which the first such pair tells."""
    columns: list[float] = []
    for c, n in clusters if height >= 2 else ():
        if n >= max(2, -(-height // 2)):
            if columns and not c - columns[-1] > rules.gap:
                return []
            columns.append(c)
    return columns if len(columns) >= 2 and (rules.most_columns is None or len(columns) <= rules.most_columns) else []


def table_regions(lines: Sequence[Line], barred: Callable[[Line], bool], rules: TableRules) -> list[tuple[int, int, list[float]]]:
    """Half-open runs of lines that share columns, with the columns, each begun at the first line that can."""
    found, at = [], 0
    stops = [barred(line) or not line.xs for line in lines]
    places = sorted({x for line, stop in zip(lines, stops, strict=True) if not stop for x in line.xs})
    ranks = {x: i for i, x in enumerate(places)}
    lefts = [[] if stop else [ranks[x] for x in line.xs] for line, stop in zip(lines, stops, strict=True)]
    while at < len(lines):
        if stops[at]:
            at += 1
            continue
        held, end = [0] * len(places), at  # the open run's left edges, as counts
        while end < len(lines) and not stops[end]:
            for i in lefts[end]:
                held[i] += 1
            if end > at and not _goes_on(lines[end].xs, _clusters(places, held, rules.cluster), rules.touch):
                for i in lefts[end]:
                    held[i] -= 1
                break
            end += 1
        columns = _columns(_clusters(places, held, rules.cluster), end - at, rules)
        good = bool(columns)
        if good and rules.fill is not None:
            good = sum(sum(_touches(line.xs, c, rules.fill) for c in columns) >= 2 for line in lines[at:end]) >= 2
        if good:
            found.append((at, end, columns))
        at = end if good else at + 1
    return found


def pipe_table(lines: Sequence[Line], columns: list[float], rules: TableRules, merge: bool) -> str | None:
    """A pipe table, or None under two rows; with ``merge``, rows without a first cell continue the row before."""
    grid: list[list[str]] = []
    for line in lines:
        cells: list[list[str]] = [[] for _ in columns]
        for x, text in line.cells:
            cells[max(sum(c <= x + rules.assign for c in columns) - 1, 0)].append(text)
        row = [squeeze(" ".join(c)) for c in cells]
        if merge and grid and not row[0] and any(row):
            grid[-1] = [f"{a} {b}".strip(SPACES) if b else a for a, b in zip(grid[-1], row, strict=True)]
        else:
            grid.append(row)
    return markdown_table(grid) if len(grid) >= 2 else None


def markdown_table(grid: list[list[str]]) -> str:
    rows = ["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in grid]
    return "\n".join([rows[0], "| " + " | ".join("---" for _ in grid[0]) + " |", *rows[1:]])


@dataclass
class Writer:
    """Markdown of a page: blocks stand apart, list items follow each other, body text waits for its paragraph's end."""

    out: list[str] = field(default_factory=list)
    chunks: list[str] = field(default_factory=list)

    def end_paragraph(self) -> None:
        if self.chunks:
            self.out += [" ".join(self.chunks), ""]
            self.chunks = []

    def block(self, text: str | None) -> None:
        self.end_paragraph()
        if self.out and self.out[-1]:
            self.out.append("")
        if text:
            self.out += [text, ""]

    def item(self, text: str) -> None:
        self.end_paragraph()
        self.out.append(text)

    def body(self, text: str, keep_hyphens: bool) -> None:
        """Add a line; a word broken by a hyphen is made whole, unless its first part is a prefix that keeps it."""
        if self.chunks and _HYPHEN.search(self.chunks[-1]):
            broken = self.chunks[-1]
            stem = re.split(f"[{SPACES}]", broken)[-1][:-1].lower()
            if not (keep_hyphens and stem in COMPOUND_PREFIXES):
                head, *rest = re.split(f"[{SPACES}]", text)
                self.chunks[-1] = broken[:-1] + head
                self.chunks.append(" ".join(rest))
                return
        self.chunks.append(text)

    def text(self) -> str:
        self.end_paragraph()
        return re.sub("\n{3,}", "\n\n", "\n".join(self.out)).strip(SPACES)


def page_markdown(lines: Sequence[Line], modal: float, extended: bool = True, hyphens: bool = True) -> str:
    """Markdown of a page of embedded text."""
    tables = {start: (end, columns) for start, end, columns in (table_regions(lines, lambda line: line.level > 0, TEXT_TABLES) if extended else [])}
    inside = {i for start, (end, _) in tables.items() for i in range(start, end)}
    writer, at = Writer(), 0
    while at < len(lines):
        line = lines[at]
        if at in tables:
            end, columns = tables[at]
            writer.block(pipe_table(lines[at:end], columns, TEXT_TABLES, merge=True))
            at = end
            continue
        if line.text and line.marker is not None:
            writer.item(f"{line.marker}. {line.marked}")
        elif line.text and line.level:
            words, first = [line.text], line.y
            while at + 1 < len(lines) and at + 1 not in inside:
                after = lines[at + 1]
                if after.level != line.level or after.marker is not None or abs(after.y - first) >= modal * 2.2:
                    break
                words.append(after.text)
                at += 1
            writer.block("#" * line.level + " " + " ".join(words))
        elif line.text and (m := _BULLET.match(line.text)):
            writer.item(f"- {m[1]}")
        elif line.text and (m := _NUMBER.match(line.text)):
            writer.item(f"1. {m[1]}")
        elif line.text:
            if writer.chunks and at and abs(lines[at - 1].y - line.y) > line.h * 2.0:
                writer.end_paragraph()
            writer.body(line.text, hyphens)
        at += 1
    return writer.text()


def lines_of_items(items: DataFrame, options: ConvertOptions, keys: Sequence[str] = PAGE) -> DataFrame:
    """Lines of positioned items (with page_width and page_height), each with its heading level."""
    ordered = reading_order(items, keys=keys, respect_columns=options.respect_columns)
    lines = line_table(number_lines(with_modal_height(ordered, keys, "read_pos"), keys), keys)
    return lines.withColumn("level", heading_level(F.col("text"), F.col("h"), F.col("modal_h")))


def page_rows(lines: DataFrame, columns: Sequence[str], keys: Sequence[str] = PAGE) -> DataFrame:
    """One row for each page, with its lines (line_no and the columns) as an ordered array."""
    return lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", *columns))).alias("lines"))


def render_pages(lines: DataFrame, options: ConvertOptions, keys: Sequence[str] = PAGE) -> DataFrame:
    """Rows (keys, markdown, error), one for each page of ``lines``."""
    extended, hyphens, limit = options.extended, options.hyphens, options.limits.max_conversion_ms
    bounded_batches(lines.sparkSession)
    flat = ("line_no", "y", "h", "text", "level", "modal_h", "marker", "marked")
    marks = {"marker": F.when(F.col("ol_cand"), F.col("ol_marker")), "marked": F.coalesce("ol_text", F.lit(""))}
    line = F.struct(*[marks.get(c, F.col(c)).alias(c) for c in flat], "xs", F.col("items")["x"].alias("cell_xs"), F.col("items")["str"].alias("strs"))
    pages = lines.groupBy(*keys).agg(F.collect_list(line).alias("lines"))

    def page_lines(found: pa.Array) -> list[tuple]:
        arrays = [lists(pc.struct_field(found, [c]), values) for c in ("xs", "cell_xs", "strs")]
        return list(zip(*[values(pc.struct_field(found, [c])) for c in flat], *arrays, strict=True))

    def render(batches):
        for batch in batches:
            out: list[tuple[str | None, str | None]] = []
            for rows in lists(batch.column("lines"), page_lines):
                try:
                    with within(limit):
                        rows.sort(key=lambda r: r[0])
                        page = [Line(y, h, text, xs, list(zip(cell_xs, strs, strict=True)), level, marker, marked) for _, y, h, text, level, _, marker, marked, xs, cell_xs, strs in rows]
                        out.append((page_markdown(page, rows[0][5], extended, hyphens), None))
                except OutOfTime:
                    out.append((None, TIMED_OUT))
                except Exception as e:  # one page must not end the job
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=[*keys, "markdown", "error"])

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(render, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "markdown string, error string"]))


def find_tables(lines: DataFrame, rules: TableRules = TEXT_TABLES, keys: Sequence[str] = PAGE) -> DataFrame:
    """Rows (keys, start_line, end_line, columns): half-open runs of a page's lines that are tables.

    ``lines`` has line_no, xs and barred, which tells the lines that no table holds. A run is a fold over
    lines with the sorted left edges of the open run as its state; lines are counted from 0 in their order.
    """
    pages = page_rows(lines, ("xs", "barred"), keys)

    def find(batches):
        for batch in batches:
            at, out = [], []
            for i, rows in enumerate(batch.column("lines").to_pylist()):
                page = [Line(0.0, 0.0, "", r["xs"] or [], [], int(bool(r["barred"]))) for r in rows]
                for found in table_regions(page, lambda line: line.level > 0, rules):
                    at.append(i)
                    out.append(found)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(where) for k in keys), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                names=[*keys, "start_line", "end_line", "columns"],
            )

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(find, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "start_line int, end_line int, columns array<double>"]))


def heading_runs(lines: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Rows (keys, first_line, n_lines, level, text): headings that go over several lines, made one.

    ``lines`` has line_no, y, text, level (0: no heading), modal_h, and free (false: in a table, or a list item). A line goes on with
    the run before it where it follows it, has its level, and stands within 2.2 modal heights of the run's first line, whose place is the fold's state.
    """
    pages = page_rows(lines, ("y", "text", "level", "free", "modal_h"), keys)
    run = "struct<first_line:int,n_lines:int,level:int,y:double,texts:array<string>>"

    def step(runs, indexed):
        line, at = indexed["line"], indexed["at"]
        last = F.try_element_at(runs, F.lit(-1))
        heads = F.coalesce(line["free"] & (line["level"] > 0) & (line["text"] != ""), F.lit(False))
        goes_on = last.isNotNull() & (last["first_line"] + last["n_lines"] == at) & (last["level"] == line["level"]) & (F.abs(line["y"] - last["y"]) < line["modal_h"] * F.lit(2.2))
        grown = F.struct(last["first_line"].alias("first_line"), (last["n_lines"] + 1).alias("n_lines"), last["level"].alias("level"), last["y"].alias("y"), F.concat(last["texts"], F.array(line["text"])).alias("texts"))
        begun = F.struct(at.alias("first_line"), F.lit(1).alias("n_lines"), line["level"].cast("int").alias("level"), line["y"].alias("y"), F.array(line["text"]).alias("texts"))
        before = F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))
        return F.when(heads & F.coalesce(goes_on, F.lit(False)), F.concat(before, F.array(grown))).when(heads, F.concat(runs, F.array(begun))).otherwise(runs).cast(f"array<{run}>")

    indexed = F.transform("lines", lambda line, at: F.struct(line.alias("line"), at.alias("at")))
    runs = F.aggregate(indexed, F.array().cast(f"array<{run}>"), step)
    out = pages.select(*keys, F.explode(runs).alias("r"))
    return out.select(*keys, "r.first_line", "r.n_lines", "r.level", F.array_join("r.texts", " ").alias("text"))


def repaired_paragraphs(lines: DataFrame, keep_hyphens: bool = True, keys: Sequence[str] = (*PAGE, "para_no")) -> DataFrame:
    """Rows (keys, text): the lines of a paragraph (line_no, text) in order, words broken by a hyphen made whole.

    The fold's state is the list of chunks so far: a line after a broken word gives its first word to it, and the rest is a chunk of its own.
    With ``keep_hyphens`` first parts that are prefixes of compounds keep their hyphen.
    """
    pages = page_rows(lines, ("text",), keys)
    space = f"[{SPACES}]"

    def step(chunks, line):
        last = F.try_element_at(chunks, F.lit(-1))
        broken = F.coalesce(F.right(last, F.lit(2)).rlike(r"^[A-Za-z]-\z"), F.lit(False))
        stem = F.lower(F.regexp_extract(last, rf"([^{SPACES}]*)-\z", 1))
        kept = stem.isin(*COMPOUND_PREFIXES) if keep_hyphens else F.lit(False)
        words = F.split(line["text"], space, -1)
        joined = F.concat(F.substring(last, F.lit(1), F.length(last) - 1), words[0])
        before = F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0)))
        rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
        return F.when(broken & ~kept, F.concat(before, F.array(joined, rest))).otherwise(F.concat(chunks, F.array(line["text"])))

    return pages.select(*keys, F.array_join(F.aggregate("lines", F.array().cast("array<string>"), step), " ").alias("text"))
