"""Registered queries of the folds over a page's lines, beside recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.operators import layout, ocr, page_layout
from parchmint.operators.page_layout import OCR_TABLES, TEXT_TABLES, TableRules
from parchmint.options import COMPOUND_PREFIXES, ConvertOptions
from parchmint.plans import queries
from parchmint.plans.queries import _OCR, WS, lit, query
from parchmint.plans.sql_surface import register, with_views
from parchmint.plans.views import MARKED, TYPESET, dealt_documents, line_ctes, marked_lines, typeset

# Documents set wider: words 72 points apart and at most five on a line, heights alike for two lines each.
_WIDE = "WITH RECURSIVE" + TYPESET + """, spread AS (
        SELECT doc_id, page_no, item_idx, str, 72 + (x - 72) * 2 AS x, y, (10 + (doc_id + item_idx // 200000) % 3)::DOUBLE AS height FROM typeset WHERE x < 72 + 36 * 5
    )""" + line_ctes("spread")


def _wide_lines(spark, d) -> DataFrame:
    words = typeset(spark, d).where(F.col("x") < 72 + 36 * 5)
    spread = words.withColumns({"x": 72 + (F.col("x") - 72) * 2, "height": (10 + (F.col("doc_id") + F.floor(F.col("item_idx") / 200000)) % 3).cast("double")})
    lines = layout.line_table(layout.number_lines(layout.with_modal_height(layout.strip_margins(spread, F.lit(792.0)))))
    return lines.withColumn("level", T.heading_level(F.col("text"), F.col("h"), F.col("modal_h")))


def _tables_sql(barred: str, rules: TableRules) -> str:
    """Common table expressions of runs of lines that are tables (``walk``), by one recursive step for each line that is tried.

    A step adds the line at ``i`` to the run that began at ``s`` (-1: none is open), or ends the run there. Clusters are
    folded from the sorted edges with their sums and counts.
    """
    pool = "list_transform(list_sort({xs}), lambda v: [{{'s': v, 'n': 1}}])"
    folded = f"""list_reduce({pool}, lambda acc, one: CASE
        WHEN one[1].s - acc[-1].s / acc[-1].n <= {rules.cluster}::DOUBLE THEN list_append(acc[:-2], {{{{'s': acc[-1].s + one[1].s, 'n': acc[-1].n + 1}}}})
        ELSE list_append(acc, one[1]) END)"""
    fill = f"len(list_filter(lines_xs[s + 1 : i], lambda xs: len(list_filter(cols, lambda c: len(list_filter(xs, lambda x: abs(x - c) <= {rules.fill})) > 0)) >= 2)) >= 2" if rules.fill is not None else "true"
    most = f"len(cols) <= {rules.most_columns}" if rules.most_columns is not None else "true"
    return f""", page AS MATERIALIZED (
        SELECT doc_id, page_no, list(xs ORDER BY ln) AS lines_xs, list({barred} ORDER BY ln) AS bars, count(*) AS n FROM (
            SELECT l.*, x.xs FROM leveled l JOIN (SELECT doc_id, page_no, ln, list(x ORDER BY x, ord) AS xs FROM numbered GROUP BY 1, 2, 3) x USING (doc_id, page_no, ln)) GROUP BY 1, 2
    ), walk AS (
        SELECT doc_id, page_no, 0::BIGINT AS i, -1::BIGINT AS s, []::DOUBLE[] AS pool, -1::BIGINT AS t0, -1::BIGINT AS t1, []::DOUBLE[] AS tcols FROM page
        UNION ALL
        SELECT doc_id, page_no,
               CASE WHEN s = -1 THEN CASE WHEN bars[i + 1] THEN i + 1 ELSE i END WHEN fits THEN i + 1 WHEN good THEN i ELSE s + 1 END,
               CASE WHEN s = -1 THEN CASE WHEN bars[i + 1] THEN -1 ELSE i END WHEN fits THEN s ELSE -1 END,
               CASE WHEN s <> -1 AND fits THEN wider ELSE [] END,
               CASE WHEN s <> -1 AND NOT fits AND good THEN s ELSE -1 END, CASE WHEN s <> -1 AND NOT fits AND good THEN i ELSE -1 END,
               CASE WHEN s <> -1 AND NOT fits AND good THEN cols ELSE [] END
        FROM (
            SELECT *, i - s >= 2 AND len(cols) >= 2 AND {most} AND len(list_filter(list_zip(cols[2:], cols[:-2]), lambda z: z[1] - z[2] <= {rules.gap})) = 0 AND {fill} AS good FROM (
                SELECT *, list_transform(list_filter(grown, lambda c: c.n >= greatest(2, (i - s + 1) // 2)), lambda c: c.s / c.n) AS cols FROM (
                    SELECT *, CASE WHEN s = -1 OR i >= n OR bars[i + 1] OR len(lines_xs[i + 1]) = 0 THEN false WHEN i = s THEN true
                                   ELSE len(shared) >= 2 AND len(list_filter(shared, lambda c: len(list_filter(lines_xs[i + 1], lambda x: abs(x - c) <= {rules.touch})) > 0)) > 0 END AS fits,
                           CASE WHEN len(pool) = 0 THEN [] ELSE {folded.format(xs='pool')} END AS grown
                    FROM (
                        SELECT *, list_transform(list_filter(CASE WHEN len(wider) = 0 THEN [] ELSE {folded.format(xs='wider')} END, lambda c: c.n >= 2), lambda c: c.s / c.n) AS shared
                        FROM (SELECT w.doc_id, w.page_no, w.i, w.s, w.pool, p.lines_xs, p.bars, p.n, list_concat(w.pool, coalesce(p.lines_xs[w.i + 1], [])) AS wider
                              FROM walk w JOIN page p USING (doc_id, page_no) WHERE w.i < p.n OR w.s <> -1)))))
    )"""


_REGIONS = " SELECT doc_id, page_no, t0 AS start_line, t1 AS end_line, unnest(range(len(tcols))) AS col_no, unnest(tcols) AS x FROM walk WHERE t0 <> -1"


def _columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "page_no", "start_line", "end_line", F.posexplode("columns").alias("col_no", "x"))


@query("table_regions", _WIDE + _tables_sql("level > 0", TEXT_TABLES) + _REGIONS)
def table_regions(spark, d):
    return _columns(page_layout.find_tables(_wide_lines(spark, d).withColumn("barred", F.col("level") > 0)))


_NO_TABLE = rf"""(regexp_matches(text, '^(?i:EXHIBIT){WS}+[A-Za-z0-9]') OR (regexp_matches(regexp_replace(text, '[^A-Za-z]', '', 'g'), '^[A-Z]{{3,}}$') AND length(text) BETWEEN 3 AND 80)
    OR regexp_matches(text, '^[0-9]{{1,2}}\.{WS}+') OR regexp_matches(text, '^[•\-*·]{WS}+'))"""


@query("ocr_table_regions", _WIDE + _tables_sql(_NO_TABLE, OCR_TABLES) + _REGIONS)
def ocr_table_regions(spark, d):
    return _columns(page_layout.find_tables(_wide_lines(spark, d).withColumn("barred", ocr.no_table_line(F.col("text"))), OCR_TABLES))


@query(
    "heading_runs",
    _WIDE
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ln) - 1 AS k FROM leveled),
    runs AS (
        SELECT doc_id, page_no, 0::BIGINT AS k, CASE WHEN level > 0 THEN 0 ELSE -1 END::BIGINT AS first_line, level::BIGINT AS level, y AS first_y, text FROM placed WHERE k = 0
        UNION ALL
        SELECT doc_id, page_no, k, CASE WHEN level = 0 THEN -1 WHEN goes_on THEN first_line ELSE k END, level, CASE WHEN goes_on THEN first_y ELSE y END, CASE WHEN goes_on THEN before || ' ' || text ELSE text END FROM (
            SELECT p.doc_id, p.page_no, p.k, p.level, p.y, p.text, r.first_line, r.first_y, r.text AS before,
                   p.level > 0 AND r.first_line >= 0 AND r.level = p.level AND abs(p.y - r.first_y) < p.modal_h * 2.2::DOUBLE AS goes_on
            FROM runs r JOIN placed p ON p.doc_id = r.doc_id AND p.page_no = r.page_no AND p.k = r.k + 1)
    ) SELECT doc_id, page_no, first_line, count(*) AS n_lines, any_value(level) AS level, arg_max(text, k) AS text FROM runs WHERE first_line >= 0 GROUP BY doc_id, page_no, first_line""",
)
def heading_runs(spark, d):
    return page_layout.heading_runs(_wide_lines(spark, d).withColumn("free", F.lit(True)))


#: Endings put to some lines, so that words are broken there: some after prefixes that keep their hyphen.
_ENDS = ("", " self-", " mark-", "", " Well-", " x1-", " re-")


@query(
    "hyphen_repair",
    "WITH RECURSIVE" + MARKED + f""", body AS (
        SELECT doc_id, line_no // 6 AS para_no, line_no % 6 AS k, line || [{', '.join(map(lit, _ENDS))}][1 + (doc_id + line_no) % {len(_ENDS)}] AS text FROM marked
    ), chunks AS (
        SELECT doc_id, para_no, k, [text] AS held FROM body WHERE k = 0
        UNION ALL
        SELECT doc_id, para_no, k, CASE WHEN broken AND NOT list_contains([{', '.join(map(lit, COMPOUND_PREFIXES))}], lower(regexp_extract(held[-1], '([^{WS[1:-1]}]*)-$', 1)))
            THEN list_concat(held[:-2], [left(held[-1], length(held[-1]) - 1) || words[1], array_to_string(words[2:], ' ')]) ELSE list_append(held, text) END
        FROM (SELECT b.doc_id, b.para_no, b.k, b.text, c.held, regexp_matches(c.held[-1], '[A-Za-z]-$') AS broken, regexp_split_to_array(b.text, '{WS}') AS words
              FROM chunks c JOIN body b ON b.doc_id = c.doc_id AND b.para_no = c.para_no AND b.k = c.k + 1)
    ) SELECT doc_id, para_no, array_to_string(arg_max(held, k), ' ') AS text FROM chunks GROUP BY doc_id, para_no""",
)
def hyphen_repair(spark, d):
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (1 + (F.col("doc_id") + F.col("line_no")) % len(_ENDS)).cast("int"))
    lines = marked_lines(spark, d, dealt_documents(spark, d)).select("doc_id", F.floor(F.col("line_no") / 6).alias("para_no"), "line_no", F.concat("line", end).alias("text"))
    return page_layout.repaired_paragraphs(lines, keys=("doc_id", "para_no"))


_FULL = (
    "WITH RECURSIVE" + TYPESET + """, margins AS (
        SELECT *, max(CASE WHEN y < 792 * 0.95::DOUBLE AND y > 792 * 0.045::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no) AS has_any FROM typeset
    ), inner_items AS (
        SELECT * EXCLUDE (has_any), CASE WHEN x < 286 THEN 'left' WHEN x >= 326 THEN 'right' ELSE 'mid' END AS zone FROM margins WHERE has_any = 0 OR (y < 792 * 0.95::DOUBLE AND y > 792 * 0.045::DOUBLE)
    ), zoned AS (
        SELECT *, count(*) FILTER (WHERE zone = 'left') OVER p AS n_left, count(*) FILTER (WHERE zone = 'right') OVER p AS n_right, count(*) FILTER (WHERE zone = 'mid') OVER p AS n_mid
        FROM inner_items WINDOW p AS (PARTITION BY doc_id, page_no)
    ), read_items AS (SELECT * FROM zoned WHERE NOT (zone = 'mid' AND n_left > 8 AND n_right > 8 AND n_mid < (n_left + n_right) * 0.12::DOUBLE)
    )""" + line_ctes("read_items")
    + f""", firsts AS (
        SELECT doc_id, page_no, ln, list(str ORDER BY x, ord) AS strs, list(x ORDER BY x, ord) AS xs FROM numbered GROUP BY 1, 2, 3
    ), marked_up AS (
        SELECT l.doc_id, l.page_no, row_number() OVER w - 1 AS k, l.y, l.h, l.modal_h, l.level, l.text,
               lag(l.y) OVER w AS y_before, len(strs) >= 2 AND xs[2] - xs[1] > 18 AND regexp_matches(regexp_replace(strs[1], '^{WS}+|{WS}+$', '', 'g'), '^([0-9]{{1,3}}|[ivxlcIVXLC]{{1,4}}|[A-Za-z])$') AS cand,
               regexp_replace(strs[1], '^{WS}+|{WS}+$', '', 'g') || '. ' || trim(regexp_replace(array_to_string(strs[2:], ' '), '{WS}+', ' ', 'g'), ' ') AS listed
        FROM leveled l JOIN firsts f USING (doc_id, page_no, ln) WINDOW w AS (PARTITION BY l.doc_id, l.page_no ORDER BY l.ln)
    ), kinds AS (
        SELECT *, CASE WHEN text = '' THEN 'none' WHEN cand THEN 'item' WHEN level > 0 THEN 'head'
            WHEN regexp_matches(text, '^[•*·○–-]{WS}+') OR regexp_matches(text, '^([0-9]+\\.|\\([A-Za-z0-9]+\\)){WS}+') THEN 'item' ELSE 'body' END AS kind,
            CASE WHEN cand THEN listed WHEN regexp_matches(text, '^[•*·○–-]{WS}+') THEN '- ' || regexp_replace(text, '^[•*·○–-]{WS}+', '')
                 ELSE '1. ' || regexp_replace(text, '^([0-9]+\\.|\\([A-Za-z0-9]+\\)){WS}+', '') END AS as_item
        FROM marked_up
    ), heads AS (
        SELECT doc_id, page_no, k, CASE WHEN kind = 'head' THEN k ELSE -1 END AS begun, y AS first_y FROM kinds WHERE k = 0
        UNION ALL
        SELECT doc_id, page_no, k, CASE WHEN kind <> 'head' THEN -1 WHEN goes_on THEN begun ELSE k END, CASE WHEN goes_on THEN first_y ELSE y END FROM (
            SELECT n.doc_id, n.page_no, n.k, n.kind, n.y, r.begun, r.first_y, n.kind = 'head' AND r.begun >= 0 AND b.level = n.level AND abs(n.y - r.first_y) < n.modal_h * 2.2::DOUBLE AS goes_on
            FROM heads r JOIN kinds b ON b.doc_id = r.doc_id AND b.page_no = r.page_no AND b.k = r.k JOIN kinds n ON n.doc_id = r.doc_id AND n.page_no = r.page_no AND n.k = r.k + 1)
    ), parts AS (
        SELECT q.*, h.begun, last_value(CASE WHEN kind <> 'none' THEN kind END IGNORE NULLS) OVER (PARTITION BY q.doc_id, q.page_no ORDER BY q.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kind_before
        FROM kinds q JOIN heads h ON h.doc_id = q.doc_id AND h.page_no = q.page_no AND h.k = q.k
    ), numbered_parts AS (
        SELECT *, CASE kind WHEN 'head' THEN begun WHEN 'item' THEN k
            ELSE max(CASE WHEN kind = 'body' AND (kind_before IS DISTINCT FROM 'body' OR abs(y_before - y) > h * 2.0::DOUBLE) THEN k END) OVER (PARTITION BY doc_id, page_no ORDER BY k) END AS element
        FROM parts WHERE kind <> 'none'
    ), elements AS (
        SELECT doc_id, page_no, element, any_value(kind) AS kind, CASE any_value(kind) WHEN 'item' THEN any_value(as_item) WHEN 'head' THEN repeat('#', any_value(level)) || ' ' || string_agg(text, ' ' ORDER BY k) ELSE string_agg(text, ' ' ORDER BY k) END AS shown
        FROM numbered_parts GROUP BY doc_id, page_no, element
    ), spaced AS (
        SELECT *, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN lag(kind) OVER w <> 'item' OR kind = 'head' THEN chr(10) || chr(10) ELSE chr(10) END AS gap FROM elements WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY element)
    ) SELECT doc_id, page_no, regexp_replace(string_agg(gap || shown, '' ORDER BY element), '^{WS}+|{WS}+$', '', 'g') AS markdown, NULL::VARCHAR AS error FROM spaced GROUP BY doc_id, page_no"""
)


@query("page_layout_full", _FULL)
def page_layout_full(spark, d):
    options = ConvertOptions()
    return page_layout.render_pages(page_layout.lines_of_items(typeset(spark, d), options), options)


@query(
    "ocr_page_full",
    _OCR.replace("WITH", "WITH RECURSIVE", 1) + f""", boxes AS (SELECT doc_id, floor(y / 50)::BIGINT AS line_no, min((2400 - y * 3)::INT) AS y0, max((2436 - y * 3)::INT) AS y1 FROM items GROUP BY 1, 2),
    texts AS (SELECT doc_id, floor(y / 50)::BIGINT AS line_no, string_agg(text, ' ' ORDER BY item_idx) AS text FROM good GROUP BY 1, 2),
    shown AS (SELECT doc_id, line_no, text, (2400 - y0) / 3.0::DOUBLE AS y, (y0 + y1) / 2.0::DOUBLE / 3.0::DOUBLE AS y_mid, (y1 - y0) / 3.0::DOUBLE AS h FROM boxes JOIN texts USING (doc_id, line_no)),
    kept AS (SELECT * FROM shown WHERE y > 800.0::DOUBLE * 0.04::DOUBLE AND y < 800.0::DOUBLE * 0.97::DOUBLE AND NOT (length(text) <= 4 AND regexp_matches(text, '^[a-z]'))),
    leveled AS (SELECT doc_id, 1 AS page_no, -line_no AS ln, text FROM kept WHERE doc_id % 2 = 1),
    numbered AS (SELECT doc_id, 1 AS page_no, -floor(y / 50)::BIGINT AS ln, x, item_idx AS ord, text FROM good)"""
    + _tables_sql(_NO_TABLE, OCR_TABLES)
    + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS k, lag(y) OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS y_before FROM kept),
    regions AS (SELECT doc_id, t0, t1, tcols FROM walk WHERE t0 <> -1),
    table_cells AS (
        SELECT doc_id, t0, k, any_value(tcols) AS tcols, col, string_agg(text, ' ' ORDER BY ord) AS cell FROM (
            SELECT p.doc_id, t0, k, tcols, n.text, n.ord, greatest(len(list_filter(tcols, lambda c: c <= n.x + {OCR_TABLES.assign})) - 1, 0) AS col
            FROM placed p JOIN regions r ON r.doc_id = p.doc_id AND k - 1 >= t0 AND k - 1 < t1 JOIN numbered n ON n.doc_id = p.doc_id AND n.ln = -p.line_no)
        GROUP BY doc_id, t0, k, col
    ), table_rows AS (
        SELECT doc_id, t0, k, any_value(tcols) AS tcols, '| ' || array_to_string(list_transform(range(len(any_value(tcols))), lambda i: coalesce(map_from_entries(list({{'k': col, 'v': cell}}))[i], '')), ' | ') || ' |' AS line FROM table_cells GROUP BY doc_id, t0, k
    ), tables AS (
        SELECT doc_id, t0, string_agg(CASE WHEN k = t0 + 1 THEN line || chr(10) || '| ' || array_to_string(list_transform(tcols, lambda c: '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY k) AS drawn FROM table_rows GROUP BY doc_id, t0
    ), kinds AS (
        SELECT p.*, r.t0, CASE WHEN p.doc_id % 2 = 0 AND y_mid BETWEEN 300 AND 540 THEN 'grid' WHEN r.t0 IS NOT NULL THEN 'table'
            WHEN regexp_matches(regexp_replace(text, '[^A-Za-z]', '', 'g'), '^[A-Z]{{3,}}$') AND length(text) BETWEEN 3 AND 60 THEN 'head' WHEN regexp_matches(text, '^[0-9]{{1,2}}\\.{WS}+') THEN 'item' ELSE 'body' END AS kind
        FROM placed p LEFT JOIN regions r ON r.doc_id = p.doc_id AND k - 1 >= r.t0 AND k - 1 < r.t1
    ), parts AS (
        SELECT *, CASE kind WHEN 'body' THEN max(CASE WHEN kind = 'body' AND (before IS DISTINCT FROM 'body' OR abs(y_before - y) > h * 2.5::DOUBLE) THEN k END) OVER (PARTITION BY doc_id ORDER BY k)
            WHEN 'grid' THEN min(k) FILTER (WHERE kind = 'grid') OVER (PARTITION BY doc_id) WHEN 'table' THEN t0 + 1 ELSE k END AS element
        FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM kinds)
    ), cells AS (
        SELECT doc_id, CASE WHEN 806 - y < 420 THEN 0 ELSE 1 END AS r, CASE WHEN x + 5 < 300 THEN 0 ELSE 1 END AS c, string_agg(text, ' ' ORDER BY item_idx) AS cell
        FROM words WHERE doc_id % 2 = 0 AND text <> '|' AND 806 - y >= 300 AND 806 - y < 540 AND x + 5 >= 36 AND x + 5 < 600 GROUP BY 1, 2, 3
    ), grids AS (
        SELECT doc_id, {' || '.join(f"'{a}' || coalesce(max(cell) FILTER (WHERE r = {r} AND c = {c}), ' ') || '{b}'" for r, c, a, b in ((0, 0, '| ', ' | '), (0, 1, '', ' |'), (1, 0, '@| --- | --- |@| ', ' | '), (1, 1, '', ' |')))} AS grid FROM cells GROUP BY doc_id
    ), elements AS (
        SELECT p.doc_id, element, CASE WHEN any_value(kind) IN ('head', 'grid', 'table') THEN 'block' ELSE any_value(kind) END AS kind, CASE any_value(kind) WHEN 'grid' THEN replace(coalesce(any_value(grid), '|   |   |@| --- | --- |@|   |   |'), '@', chr(10))
            WHEN 'table' THEN any_value(drawn) WHEN 'head' THEN '## ' || any_value(text) WHEN 'item' THEN regexp_replace(any_value(text), '^([0-9]{{1,2}}\\.){WS}+', '\\1 ') ELSE string_agg(text, ' ' ORDER BY k) END AS shown
        FROM parts p LEFT JOIN grids USING (doc_id) LEFT JOIN tables t ON t.doc_id = p.doc_id AND t.t0 = p.t0 GROUP BY p.doc_id, element
    ), spaced AS (
        SELECT *, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN lag(kind) OVER w <> 'item' OR kind = 'block' THEN chr(10) || chr(10) ELSE chr(10) END AS gap FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY element)
    ), done AS (SELECT doc_id, string_agg(gap || shown, '' ORDER BY element) AS markdown FROM spaced GROUP BY doc_id)
    SELECT doc_id, 1::BIGINT AS page_no, coalesce(markdown, '') AS markdown, NULL::VARCHAR AS error FROM (SELECT DISTINCT doc_id FROM items) LEFT JOIN done USING (doc_id)""",
)
def ocr_page_full(spark, d):
    # Words become lines, and lines pages, where they were dealt; a page's words are those of its lines.
    found = queries._ocr_boxes(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct((-F.col("line_no")).alias("line_no"), "bbox", "words")).alias("lines"))
    lines = F.when(F.col("doc_id").isNotNull(), ocr.ocr_lines(F.col("lines"), F.lit(2400), F.lit(3.0)))
    ruled = F.col("doc_id") % 2 == 0
    words = F.when(ruled, F.sort_array(F.flatten("lines.words")))
    grid = {"h_lines": F.when(ruled, F.array(F.lit(300.0), F.lit(420.0), F.lit(540.0))), "v_lines": F.when(ruled, F.array(F.lit(36.0), F.lit(300.0), F.lit(600.0)))}
    pages = found.select("doc_id", F.lit(1).alias("page_no"), F.lit(3.0).alias("scale"), F.lit("").alias("text"), lines.alias("lines"), words.alias("words"), *[c.alias(n) for n, c in grid.items()])
    return ocr.render_ocr_pages(pages)


# The same operators by their SQL names: the queries below are SQL alone.
@query("sql_page_tables", _WIDE + _tables_sql("level > 0", TEXT_TABLES) + _REGIONS)
def sql_page_tables(spark, d):
    with_views(register(spark), wide_lines=_wide_lines(spark, d))
    return spark.sql("SELECT doc_id, page_no, start_line, end_line, posexplode(columns) AS (col_no, x) FROM page_tables(TABLE(wide_lines))")


@query(
    "sql_page_markdown",
    _WIDE + " SELECT doc_id, page_no, string_agg(repeat('#', level) || ' ' || text, chr(10) || chr(10) ORDER BY ln) AS markdown, NULL::VARCHAR AS error FROM leveled WHERE level > 0 AND ln % 3 = 0 GROUP BY doc_id, page_no",
)
def sql_page_markdown(spark, d):
    with_views(register(spark), wide_lines=_wide_lines(spark, d))
    return spark.sql("SELECT * FROM page_markdown(TABLE(SELECT * EXCEPT (ol_cand), false AS ol_cand FROM wide_lines WHERE level > 0 AND line_no % 3 = 0))")


@query(
    "sql_safe_lines",
    "WITH" + MARKED + rf""" SELECT doc_id, line_no, regexp_replace(line, '\[([^\]]*)\]\({WS}*(javascript:|data:text/html)[^)]*\)', '[\1]()', 'gi') AS safe, CASE WHEN line_no % 7 = 4 THEN 'pdf' WHEN line_no % 7 = 5 THEN 'zip' END AS kind,
        round(length(line) * 100 / 1024.0::DOUBLE)::BIGINT AS kb FROM marked WHERE line <> '' AND length(line) < 10000""",
)
def sql_safe_lines(spark, d):
    with_views(register(spark), marked=marked_lines(spark, d))
    return spark.sql("""
        SELECT doc_id, line_no, safe_links(line) AS safe, file_kind(concat(CASE line_no % 7 WHEN 4 THEN X'255044462D' WHEN 5 THEN X'504B0304' ELSE X'' END, CAST(line AS BINARY))) AS kind,
               CAST(split(size_label(length(line) * 100), ' ')[0] AS BIGINT) AS kb
        FROM marked WHERE line <> '' AND length(line) < 10000""")
