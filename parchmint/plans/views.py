"""Document-shaped views of the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions.text import WS
from parchmint.operators.layout import dealt, printable

PAGE_HEIGHT, PAGE_WIDTH = 792.0, 612.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """Integers as longs, so that widths are alike in every engine."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


#: Characters of a document for one of its words, about.
_WORD_CHARS = 6


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts dealt by document, before they become many rows."""
    docs = table(spark, sf_dir, "documents")
    chars = docs.agg(F.sum("n_chars")).first()[0] or 0
    return dealt(docs.select("doc_id", "text"), ["doc_id"], chars // _WORD_CHARS)


def marked_lines(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Lines of documents (line_no from 0); some begin with list, section and link marks."""
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    kind = F.col("line_no") % 7
    mark = F.when(kind == 1, "1. ").when(kind == 2, "• ").when(kind == 3, "II. ").when(kind == 4, "[w](javascript:w)").otherwise("")
    return lines.select("doc_id", "line_no", F.concat(mark, F.col("raw")).alias("line"))


MARKED = """
    split_lines AS (
        SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS raw FROM documents
    ), marked AS (
        SELECT doc_id, line_no, (CASE line_no % 7 WHEN 1 THEN '1. ' WHEN 2 THEN '• ' WHEN 3 THEN 'II. ' WHEN 4 THEN '[w](javascript:w)' ELSE '' END) || raw AS line FROM split_lines
    )"""


def typeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set in words: fifty lines a page, fourteen points apart, heights of 10 to 14."""
    words = marked_lines(spark, sf_dir, dealt_documents(spark, sf_dir)).select("doc_id", "line_no", F.posexplode(F.split("line", " ", -1)).alias("word_no", "str"))
    items = words.select(
        "doc_id", F.floor(F.col("line_no") / 50).cast("int").alias("page_no"), (F.col("line_no").cast("long") * 100000 + F.col("word_no")).alias("item_idx"), "str",
        (72 + 36 * F.col("word_no")).cast("double").alias("x"), (792 - 14 * (F.col("line_no") % 50)).cast("double").alias("y"),
        (10 + (F.col("doc_id") + F.col("line_no")) % 5).cast("double").alias("height"), F.lit(PAGE_WIDTH).alias("page_width"), F.lit(PAGE_HEIGHT).alias("page_height"),
    )
    return printable(items)


TYPESET = (
    MARKED
    + f""", words AS (
        SELECT doc_id, line_no, generate_subscripts(string_split(line, ' '), 1) - 1 AS word_no, unnest(string_split(line, ' ')) AS str FROM marked
    ), typeset AS (
        SELECT doc_id, line_no // 50 AS page_no, line_no * 100000 + word_no AS item_idx, str, (72 + 36 * word_no)::DOUBLE AS x, (792 - 14 * (line_no % 50))::DOUBLE AS y,
               (10 + (doc_id + line_no) % 5)::DOUBLE AS height
        FROM words WHERE regexp_replace(str, '{WS}+', '', 'g') <> ''
    )"""
)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items: one page for each order, with an ordinal."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    return dealt(rows, ["l_orderkey"], rows.count()).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.row_number().over(w).alias("item_idx"), F.concat("l_returnflag", "l_linestatus").alias("str"),
        (F.col("l_partkey") * 37 % 540 + 36).cast("double").alias("x"), (F.col("l_suppkey") * 53 % 760 + 16).cast("double").alias("y"),
        (6 + F.col("l_linenumber") % 13).cast("double").alias("height"), (F.col("l_partkey") % 101).cast("double").alias("confidence"), F.col("l_linenumber").cast("long").alias("num"),
    )


ITEMS = """
    items AS (
        SELECT l_orderkey AS doc_id, 0 AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS item_idx,
               l_returnflag || l_linestatus AS str, (l_partkey * 37 % 540 + 36)::DOUBLE AS x, (l_suppkey * 53 % 760 + 16)::DOUBLE AS y,
               (6 + l_linenumber % 13)::DOUBLE AS height, (l_partkey % 101)::DOUBLE AS confidence, l_linenumber::BIGINT AS num
        FROM lineitem
    )"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gray pixels of images by user group: 100 pixels a row."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("image"), F.floor(n / 100).cast("long").alias("y"), (n % 100).cast("long").alias("x"), ((F.col("user_id") * 31 + n * 7) % 256).cast("int").alias("v"))


PIXELS = """
    pixels AS (
        SELECT user_id % 5 AS image, event_id // 100 AS y, event_id % 100 AS x, ((user_id * 31 + event_id * 7) % 256)::INT AS v FROM events
    )"""


def line_ctes(source: str) -> str:
    """SQL of margins, modal height, lines and heading levels over a relation of items."""
    return f""", banded AS (
        SELECT *, max(CASE WHEN y < 792 * 0.95::DOUBLE AND y > 792 * 0.045::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no) AS has_body FROM {source}
    ), body AS (
        SELECT * FROM banded WHERE has_body = 0 OR (y < 792 * 0.95::DOUBLE AND y > 792 * 0.045::DOUBLE)
    ), modal AS (
        SELECT doc_id, page_no, coalesce(arg_max(k, (n, -first)) FILTER (WHERE k IS NOT NULL), 10.5::DOUBLE) AS modal_h FROM (
            SELECT doc_id, page_no, CASE WHEN height BETWEEN 6 AND 18 THEN floor(height * 2 + 0.5::DOUBLE) / 2.0::DOUBLE END AS k, count(*) AS n, min(item_idx) AS first
            FROM body GROUP BY 1, 2, 3) GROUP BY 1, 2
    ), stepped AS (
        SELECT b.*, m.modal_h, row_number() OVER w AS ord, CASE WHEN abs(y - lag(y) OVER w) > greatest(2.5::DOUBLE, m.modal_h * 0.5::DOUBLE) THEN 1 ELSE 0 END AS step
        FROM body b JOIN modal m USING (doc_id, page_no) WINDOW w AS (PARTITION BY b.doc_id, b.page_no ORDER BY y DESC, x, item_idx)
    ), numbered AS (
        SELECT *, sum(step) OVER (PARTITION BY doc_id, page_no ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS ln FROM stepped
    ), lines AS (
        SELECT doc_id, page_no, ln, arg_min(y, (x, ord)) AS y, min(x) AS x0, max(height) AS h, any_value(modal_h) AS modal_h, count(*) AS n_items,
               trim(regexp_replace(string_agg(str, ' ' ORDER BY x, ord), '{WS}+', ' ', 'g'), ' ') AS text
        FROM numbered GROUP BY 1, 2, 3
    ), leveled AS (
        SELECT *, CASE WHEN text = '' THEN 0
            WHEN h >= modal_h * 1.35::DOUBLE THEN 1
            WHEN regexp_matches(text, '^[IVXLC]{{1,5}}\\.{WS}+[^{WS[1:]}') AND h >= modal_h * 1.05::DOUBLE THEN 2
            WHEN regexp_matches(text, '^[0-9]{{1,2}}\\.{WS}+[A-Z]') AND h >= modal_h * 1.12::DOUBLE AND length(text) < 60 THEN 2
            WHEN regexp_matches(text, '^(?i:Exhibit){WS}+[A-Za-z0-9]') AND h >= modal_h * 1.05::DOUBLE THEN 2
            WHEN regexp_matches(regexp_replace(text, '[^A-Za-z]', '', 'g'), '^[A-Z]{{3,}}$') AND length(text) <= 45 AND h >= modal_h * 1.03::DOUBLE THEN 2
            WHEN regexp_matches(text, '^[A-Z]\\.{WS}+[^{WS[1:]}') AND h >= modal_h AND length(text) < 75 THEN 3
            WHEN h >= modal_h * 1.22::DOUBLE THEN 2 WHEN h >= modal_h * 1.1::DOUBLE THEN 3 ELSE 0 END AS level FROM lines
    )"""
