"""Operators under SQL names: scalar functions, and table functions over a page's lines.

``register`` makes them known to a session:

    SELECT page_id, html_markdown(html) FROM pages
    SELECT * FROM page_markdown(TABLE(lines))

Table functions part their input by doc_id and page_no and order it by line_no themselves, so
calls name no partitions. Their columns are those of ``lines_of_items``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from parchmint.functions.text import LINK
from parchmint.functions.unicode import composed
from parchmint.operators.deadlines import OutOfTime, within
from parchmint.operators.html_markdown import html_markdown
from parchmint.operators.page_layout import TEXT_TABLES, Line, page_markdown, table_regions
from parchmint.options import TIMED_OUT, Limits

_PAGE = ("doc_id", "page_no")

#: Functions whose body is SQL, with the patterns of the library: they are inlined where they are called.
_SCALARS = {
    "safe_links": f"(md STRING) RETURNS STRING RETURN regexp_replace(md, r'{LINK}', '[$1]()')",
    "file_kind": "(content BINARY) RETURNS STRING RETURN CASE WHEN substring(content, 1, 5) = X'255044462D' THEN 'pdf' WHEN substring(content, 1, 4) = X'504B0304' THEN 'zip' END",
    "size_label": "(bytes BIGINT) RETURNS STRING RETURN CASE WHEN bytes >= 1048576 THEN format_string('%.1f MB', bytes / 1048576D) ELSE format_string('%.0f KB', bytes / 1024D) END",
    "progress_percent": "(page BIGINT, pages BIGINT) RETURNS BIGINT RETURN floor(page / pages * 90 + 0.5D)",
}


@F.pandas_udf(StringType())
def _html_markdown(html: pd.Series) -> pd.Series:
    """Markdown of allowed elements; null where a document cannot be read."""

    def one(text):
        try:
            return html_markdown(text or "", True)
        except Exception:  # one document must not end the job
            return None

    return html.map(one)


def _by_page(lines: AnalyzeArgument, needed: tuple[str, ...], out: StructType) -> AnalyzeResult:
    """The schema of a table function: the page's keys as they come, and what the function adds."""
    if not lines.isTable:
        raise ValueError("the argument is a table: page_markdown(TABLE(lines))")
    missing = [c for c in (*_PAGE, "line_no", *needed) if c not in lines.dataType.names]
    if missing:
        raise ValueError(f"the table of lines lacks {', '.join(missing)}")
    schema = StructType([lines.dataType[k] for k in _PAGE])
    for field in out:
        schema.add(field)
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(k) for k in _PAGE], orderBy=[OrderingColumn("line_no")])


class PageMarkdown:
    """page_markdown(TABLE lines): rows (doc_id, page_no, markdown, error), one for each page."""

    def __init__(self):
        self.rows: list = []

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        return _by_page(lines, ("y", "h", "text", "xs", "items", "level", "modal_h", "ol_cand", "ol_marker", "ol_text"), StructType().add("markdown", StringType()).add("error", StringType()))

    def eval(self, lines):
        self.rows.append(lines)

    def terminate(self):
        markdown = error = None
        try:
            with within(Limits().max_conversion_ms):
                page = [Line(r["y"], r["h"], r["text"], r["xs"], [(i["x"], i["str"]) for i in r["items"]], r["level"], r["ol_marker"] if r["ol_cand"] else None, r["ol_text"] or "") for r in self.rows]
                markdown = page_markdown(page, self.rows[0]["modal_h"])
        except OutOfTime:
            error = TIMED_OUT
        except Exception as e:  # one page must not end the job
            error = f"{type(e).__name__}: {e}"[:500]
        yield self.rows[0]["doc_id"], self.rows[0]["page_no"], markdown, error


class PageTables:
    """page_tables(TABLE lines): rows (doc_id, page_no, start_line, end_line, columns) of a page's tables; headings are in none."""

    def __init__(self):
        self.rows: list = []

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        out = StructType().add("start_line", IntegerType()).add("end_line", IntegerType()).add("columns", ArrayType(DoubleType()))
        return _by_page(lines, ("xs", "level"), out)

    def eval(self, lines):
        self.rows.append(lines)

    def terminate(self):
        page = [Line(0.0, 0.0, "", r["xs"], [], r["level"]) for r in self.rows]
        for start, end, columns in table_regions(page, lambda line: line.level > 0, TEXT_TABLES):
            yield self.rows[0]["doc_id"], self.rows[0]["page_no"], start, end, columns


def register(spark: SparkSession) -> SparkSession:
    """Make the operators known to a session's SQL; again does no harm."""
    for name, body in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("nfc", composed)
    spark.udf.register("html_markdown", _html_markdown)
    spark.udtf.register("page_markdown", F.udtf(PageMarkdown))
    spark.udtf.register("page_tables", F.udtf(PageTables))
    return spark


def with_views(spark: SparkSession, **tables: DataFrame) -> SparkSession:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark
