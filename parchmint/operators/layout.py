"""Layout of positioned text items as relations: order, lines, clusters, columns, grids.

Tables carry the keys of a page, usually (doc_id, page_no), and an ordinal
item_idx; y grows upwards. Windows are partitioned by page, so their size does not
grow with the corpus. Every order ends with the ordinal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.text import BLANKS, OPEN_LINK, WS, collapse, escape_pipes, sanitize_links
from parchmint.sources.scratch import Scratch

PAGE = ("doc_id", "page_no")
Keys = Sequence[str]
#: Items of a partition where items are dealt by page: the memory of a task's sorts follows from it, whatever the table's size.
DEALT_ITEMS = 250_000


def dealt(df: DataFrame, keys: Keys, items: int) -> DataFrame:
    """Rows dealt by key over as many partitions as ``items`` need; windows, groups and joins on the key find them there, without another shuffle."""
    return df.repartition(max(-(-items // DEALT_ITEMS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def printable(items: DataFrame, text: str = "str") -> DataFrame:
    return items.where(F.ltrim(F.col(text), F.lit(BLANKS)) != "")


def _inside(height: Column) -> Column:
    return (F.col("y") < height * F.lit(0.95)) & (F.col("y") > height * F.lit(0.045))


def _zone(width: Column) -> Column:
    mid = width / F.lit(2.0)
    return F.when(F.col("x") < mid - 20, "left").when(F.col("x") >= mid + 20, "right").otherwise("mid")


def _two_columns(left: Column, right: Column, mid: Column) -> Column:
    return (left > 8) & (right > 8) & (mid < (left + right) * F.lit(0.12))


def strip_margins(items: DataFrame, height: Column | None = None, keys: Keys = PAGE) -> DataFrame:
    """Items between the running header and footer; a page with none there keeps all."""
    height = F.col("page_height") if height is None else height
    w = Window.partitionBy(*keys)
    return items.withColumn("_in", _inside(height)).withColumn("_any", F.max("_in").over(w)).where("_in OR NOT _any").drop("_in", "_any")


def column_zones(items: DataFrame, width: Column, keys: Keys = PAGE) -> DataFrame:
    """Adds zone (left, mid, right) and two_columns of the page."""
    w = Window.partitionBy(*keys)
    n = [F.count_if(F.col("zone") == z).over(w) for z in ("left", "right", "mid")]
    return items.withColumn("zone", _zone(width)).withColumn("two_columns", _two_columns(*n))


def reading_order(items: DataFrame, width: Column | None = None, height: Column | None = None, keys: Keys = PAGE, respect_columns: bool = False) -> DataFrame:
    """Items that count for the page, with read_pos, which ascends in reading order; in two-column pages the gutter's are left out.

    Lines are formed from y and x again, so columns change the text only with
    ``respect_columns``, which moves the right column below the left. Items are put in order first: the page's
    other windows find them so, and sort no more.
    """
    width = F.col("page_width") if width is None else width
    height = F.col("page_height") if height is None else height
    w, page, zones = Window.partitionBy(*keys).orderBy(F.desc("y"), "x", "item_idx"), Window.partitionBy(*keys), ("left", "right", "mid")
    placed = items.withColumn("_at", F.row_number().over(w)).withColumns({"_in": _inside(height), "zone": _zone(width)})
    # What strip_margins and column_zones tell, by one window: the zones' counts are those of the items within the margins, if there are any.
    within = {f"_{z}_in": F.count_if(F.col("_in") & (F.col("zone") == z)).over(page) for z in zones}
    counted = placed.withColumns({"_any": F.max("_in").over(page), **within, **{f"_{z}": F.count_if(F.col("zone") == z).over(page) for z in zones}})
    two = _two_columns(*(F.when(F.col("_any"), F.col(f"_{z}_in")).otherwise(F.col(f"_{z}")) for z in zones))
    out = counted.withColumn("two_columns", two).where("(_in OR NOT _any) AND NOT (two_columns AND zone = 'mid')")
    side = F.when(F.col("two_columns") & (F.col("zone") == "right"), 1).otherwise(0)
    out = out.withColumn("read_pos", F.shiftleft(side.cast("long"), 32) + F.col("_at")).drop("_at", "_in", "_any", *within, *(f"_{z}" for z in zones))
    if respect_columns:
        out = out.withColumn("y", F.when(side == 1, F.col("y") - 2 * height).otherwise(F.col("y")))
    return out


def modal_height(items: DataFrame, keys: Keys = PAGE, order: str = "item_idx") -> DataFrame:
    """Per page the most frequent height of 6 to 18 in halves; ties go to the one met first, none to 10.5."""
    fits = F.col("height").between(6, 18)
    step = F.when(fits, F.floor(F.col("height") * 2 + F.lit(0.5)) / F.lit(2.0))
    counts = items.groupBy(*keys, step.alias("_k")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.max_by(F.col("_k"), F.when(F.col("_k").isNotNull(), F.struct(F.col("_n"), (-F.col("_first")).alias("_f"))))
    return counts.groupBy(*keys).agg(F.coalesce(best, F.lit(10.5)).alias("modal_h"))


def with_modal_height(items: DataFrame, keys: Keys = PAGE, order: str = "item_idx") -> DataFrame:
    """Items with modal_h of their page: the same rule over windows, so the items are shuffled and read once."""
    fits = F.col("height").between(6, 18)
    step = F.when(fits, F.floor(F.col("height") * 2 + F.lit(0.5)) / F.lit(2.0))
    alike, page = Window.partitionBy(*keys, "_k"), Window.partitionBy(*keys)
    counted = items.withColumn("_k", step).withColumns({"_n": F.count("*").over(alike), "_first": F.min(order).over(alike)})
    rank = F.when(F.col("_k").isNotNull(), F.struct(F.col("_n"), (-F.col("_first")).alias("_f")))
    return counted.withColumn("modal_h", F.coalesce(F.max_by("_k", rank).over(page), F.lit(10.5))).drop("_k", "_n", "_first")


def number_lines(items: DataFrame, keys: Keys = PAGE) -> DataFrame:
    """Adds line_no (from 0) and ord to items with modal_h: a new line where y falls by more than half of it from the previous item."""
    w = Window.partitionBy(*keys).orderBy(F.desc("y"), "x", "item_idx")
    gap = F.abs(F.col("y") - F.lag("y").over(w)) > F.greatest(F.lit(2.5), F.col("modal_h") * F.lit(0.5))
    out = items.withColumn("ord", F.row_number().over(w)).withColumn("_new", F.coalesce(gap.cast("int"), F.lit(0)))
    return out.withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def line_table(numbered: DataFrame, keys: Keys = PAGE) -> DataFrame:
    """One row for each line: y and x0 of its leftmost item, largest height, text, xs, items and the list candidate."""
    item = F.struct("x", "ord", "y", "height", "str")
    lines = numbered.groupBy(*keys, "line_no").agg(F.sort_array(F.collect_list(item)).alias("items"), F.max("height").alias("h"), F.max("modal_h").alias("modal_h"))
    joined = lambda a: collapse(F.array_join(a["str"], " "))
    first, second = F.element_at("items", 1), F.get("items", F.lit(1))
    mark = F.regexp_replace(first["str"], f"^{WS}+|{WS}+\\z", "")
    cand = (F.size("items") >= 2) & mark.rlike(r"^(?:[0-9]{1,3}|[ivxlcIVXLC]{1,4}|[A-Za-z])\z") & (second["x"] - first["x"] > 18)
    return lines.withColumns(
        {
            "y": first["y"], "x0": first["x"], "text": joined(F.col("items")), "xs": F.col("items")["x"],
            "ol_cand": F.coalesce(cand, F.lit(False)), "ol_marker": F.when(cand, mark), "ol_text": F.when(cand, joined(F.slice("items", 2, 1 << 30))),
        }
    )


def cluster_anchors(xs: Column, tolerance: float = 14.0) -> Column:
    """Clusters (x, count) of an array of doubles: sorted, each joins the open cluster within ``tolerance`` of its running mean."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = last.isNotNull() & (x - last["s"] / last["n"] <= tolerance)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((last["s"] + x).alias("s"), (last["n"] + 1).alias("n"))))
        return F.when(near, grown).otherwise(F.concat(acc, F.array(F.struct(x.alias("s"), F.lit(1).alias("n")))))

    start = F.array().cast("array<struct<s:double,n:int>>")
    return F.aggregate(F.array_sort(xs), start, step, lambda acc: F.transform(acc, lambda c: F.struct((c["s"] / c["n"]).alias("x"), c["n"].alias("count"))))


def anchor_hits(anchors: Column, xs: Column, tolerance: float = 16.0) -> Column:
    """How many anchors have an x within the tolerance."""
    return F.size(F.filter(anchors, lambda a: F.exists(xs, lambda x: F.abs(x - a) <= tolerance)))


def column_of(x: Column, cols: Column, tolerance: float = 18.0) -> Column:
    """Index of the last of sorted columns that begins at most ``tolerance`` right of x; the first takes the rest."""
    return F.greatest(F.size(F.filter(cols, lambda c: c <= x + tolerance)) - 1, F.lit(0))


def well_separated(cols: Column, gap: float = 40.0) -> Column:
    """Two columns at least, each more than ``gap`` right of the one before."""
    pairs = F.zip_with(F.slice(cols, 2, F.greatest(F.size(cols) - 1, F.lit(0))), F.slice(cols, 1, F.greatest(F.size(cols) - 1, F.lit(0))), lambda b, a: b - a > gap)
    return (F.size(cols) >= 2) & F.forall(pairs, lambda ok: ok)


def grid_cells(items: DataFrame, rows: Keys, column: str = "col", order: Keys = ("x", "item_idx")) -> DataFrame:
    """One row for each filled cell of a grid: its items' strings in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "str")))
    return items.groupBy(*rows, column).agg(parts.alias("_p")).withColumn("cell", collapse(F.array_join(F.transform("_p", lambda p: p["str"]), " "))).drop("_p")


def merge_continuations(cells: DataFrame, page: Keys, row: str = "row_no", n_cols: int = 4, column: str = "col") -> DataFrame:
    """Rows whose first cell is empty while another is not go into the row before: grid_row, col, cell.

    ``cells`` has the non-empty cells; a row of ``rows`` without any begins a grid row.
    """
    w = Window.partitionBy(*page).orderBy(row)
    first = cells.groupBy(*page, row).agg(F.max((F.col(column) == 0) & (F.col("cell") != "")).alias("_head"), F.max(F.col("cell") != "").alias("_any"))
    first = first.withColumn("_new", (F.row_number().over(w) == 1) | F.col("_head") | ~F.col("_any")).withColumn("grid_row", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = cells.where("cell <> ''").join(first.select(*page, row, "grid_row"), [*page, row])
    parts = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), "cell")))
    return joined.groupBy(*page, "grid_row", column).agg(F.array_join(F.transform(parts, lambda p: p["cell"]), " ").alias("cell"))


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_pipes), " | "), F.lit(" |"))


def reflow(lines: DataFrame, factor: float = 2.0, keys: Keys = PAGE) -> DataFrame:
    """Paragraphs of body lines: a new one where y moves by more than ``factor`` heights from the previous line, or after another kind.

    ``lines`` has line_no, y, h, text and is_body; the result has para_no and text.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    breaks = F.col("is_body") & (~F.coalesce(F.lag("is_body").over(w), F.lit(False)) | (F.abs(F.lag("y").over(w) - F.col("y")) > F.col("h") * F.lit(factor)))
    marked = lines.withColumn("_b", breaks.cast("int")).withColumn("para_no", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return marked.where("is_body").groupBy(*keys, "para_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def assemble(pages: DataFrame, name: Column, doc: str = "doc_id") -> DataFrame:
    """Documents from page Markdown: a title, then each page that is not blank and a rule after it."""
    piece = F.when(F.regexp_replace("markdown", f"{WS}+", "") != "", F.concat(F.lit("\n\n"), F.col("markdown"), F.lit("\n\n---")))
    parts = F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("page_no", piece.alias("m")))))
    return pages.groupBy(doc, name.alias("name")).agg(F.concat(F.lit("# "), F.first(name), F.array_join(F.transform(parts, lambda p: p["m"]), "")).alias("markdown"))


def assemble_within(pages: DataFrame, name: Column, limit: int, doc: str = "doc_id") -> DataFrame:
    """Documents as ``assemble`` gives them, but of long ones no more pages than ``limit`` code points with safe links need.

    Pages are cut by running lengths before they are gathered. A text that safe links shorten below the limit, or in
    which a link is open at the cut, is gathered again with four times as much, until the first
    ``limit`` + 1 code points are those of the whole document; what stands after them is left out.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "assemble")
    piece = F.when(F.regexp_replace("markdown", f"{WS}+", "") != "", F.concat(F.lit("\n\n"), F.col("markdown"), F.lit("\n\n---")))
    todo = pages.select(doc, name.alias("name"), "page_no", piece.alias("m"))
    before = F.sum(F.coalesce(F.char_length("m"), F.lit(0))).over(Window.partitionBy(doc).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    out, cap, turn = None, limit, 0
    while True:
        kept = todo.withColumn("_in", F.coalesce(before, F.lit(0)) <= cap)
        parts = F.array_sort(F.collect_list(F.when(F.col("_in") & F.col("m").isNotNull(), F.struct("page_no", "m"))))
        docs = kept.groupBy(doc, "name").agg(
            F.concat(F.lit("# "), F.first("name"), F.array_join(F.transform(parts, lambda p: p["m"]), "")).alias("markdown"),
            F.bool_or(~F.col("_in") & F.col("m").isNotNull()).alias("_cut"),
        )
        unsure = (F.char_length(sanitize_links(F.col("markdown"))) <= limit) | F.col("markdown").rlike(OPEN_LINK)
        docs = scratch.save(docs.withColumn("_again", F.col("_cut") & unsure), f"docs-{turn}")
        sure = docs.where("NOT _again").select(doc, "name", "markdown")
        out = sure if out is None else out.unionByName(sure)
        again = docs.where("_again").select(doc)
        if again.isEmpty():
            return out
        todo, cap, turn = todo.join(again, doc, "left_semi"), 4 * cap, turn + 1


def span_of_lines(lines: DataFrame, spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, line_no, begins): the first of the spans (doc, b, e) that holds a line, null for none; ends are exclusive."""
    inside = (F.col("line_no") >= F.col("b")) & (F.col("line_no") < F.col("e"))
    return lines.select(doc, "line_no").join(spans, doc, "left").groupBy(doc, "line_no").agg(F.min(F.when(inside, F.col("b"))).alias("begins"))


def page_stats(lines: DataFrame, keys: Keys = PAGE) -> DataFrame:
    """Lines with text, and items, of each page."""
    return lines.groupBy(*keys).agg(F.count_if(F.col("text") != "").alias("n_lines"), F.sum(F.size("items")).alias("n_items"))


def place_in_grid(items: DataFrame, rows: Sequence[float], columns: Sequence[float]) -> DataFrame:
    """Items (x, y) within a ruled grid, with row_no and col; a cell has its upper and left rule, not the others."""

    def place(value: Column, rules: Sequence[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, rules)), lambda v: v <= value)) - 1

    placed = items.withColumn("row_no", place(F.col("y"), rows)).withColumn("col", place(F.col("x"), columns))
    return placed.where(F.col("row_no").between(0, len(rows) - 2) & F.col("col").between(0, len(columns) - 2))


def table_in_place(lines: DataFrame, inside: Column, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, line_no, shown): lines as they are, but those inside a region give way to one ``table`` at the first of them."""
    k = F.row_number().over(Window.partitionBy(doc, inside).orderBy("line_no"))
    kept = lines.withColumn("_k", k).where(~inside | (F.col("_k") == 1))
    return kept.select(doc, "line_no", F.when(inside, "table").otherwise(F.col("text")).alias("shown"))
