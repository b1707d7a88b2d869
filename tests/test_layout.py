"""Layout rules by example and against an independent statement in plain Python."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmint.operators import layout, ocr
from parchmint.operators.page_layout import OCR_TABLES, TEXT_TABLES, Line, anchors, lines_of_items, page_markdown, pipe_table, render_pages, table_regions
from parchmint.options import ConvertOptions

numbers = st.lists(st.integers(0, 400).map(float), max_size=30)


@given(numbers, st.sampled_from([14.0, 20.0]))
def test_anchors_join_the_running_mean(xs, tolerance):
    groups = []
    for x in sorted(xs):
        if groups and x - sum(groups[-1]) / len(groups[-1]) <= tolerance:
            groups[-1].append(x)
        else:
            groups.append([x])
    assert anchors(sorted(xs), tolerance) == [(sum(g) / len(g), len(g)) for g in groups]


def test_clusters_in_sql_equal_those_in_python(spark):
    rows = [[3.0, 10.0, 22.0, 40.0, 41.0, 90.0], [], [5.0], [0.0, 14.0, 21.0, 28.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, xs array<double>")
    got = [[(c.x, c["count"]) for c in r.c] for r in df.select("i", layout.cluster_anchors(F.col("xs")).alias("c")).orderBy("i").collect()]
    assert got == [anchors(sorted(r), 14.0) for r in rows]


def line(y, *cells, h=10.0, level=0, marker=None, marked=""):
    return Line(y, h, " ".join(t for _, t in cells), [x for x, _ in cells], list(cells), level, marker, marked)


def regions(lines, barred, rules):
    """The greedy rule stated plainly: clusters are counted anew for every run."""
    out, i = [], 0
    while i < len(lines):
        j, run = i, []
        while j < len(lines) and not barred(lines[j]) and lines[j].xs:
            shared = [c for c, n in anchors(sorted(x for r in [*run, lines[j]] for x in r.xs), rules.cluster) if n > 1]
            if j > i and (len(shared) < 2 or all(abs(x - c) > rules.touch for x in lines[j].xs for c in shared)):
                break
            run.append(lines[j])
            j += 1
        cols = [c for c, n in anchors(sorted(x for r in run for x in r.xs), rules.cluster) if n > 1 and 2 * n >= len(run)]
        ok = len(run) > 1 and len(cols) > 1 and min(b - a for a, b in zip(cols, cols[1:], strict=False)) > rules.gap
        ok = ok and len(cols) <= (rules.most_columns or 99)
        if ok and rules.fill:
            ok = len([r for r in run if len([c for c in cols if min(abs(x - c) for x in r.xs) <= rules.fill]) > 1]) > 1
        if ok:
            out.append((i, j, cols))
        i = j if ok else i + 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([10.0, 12.0, 80.0, 85.0, 150.0, 170.0, 260.0]), min_size=1, max_size=4), st.integers(0, 5)), max_size=9))
def test_table_regions_equal_the_plain_rule(shape):
    lines = [line(500 - 12 * k, *[(x, f"c{x:g}") for x in sorted(xs)], level=int(lv == 5)) for k, (xs, lv) in enumerate(shape)]
    for rules in (TEXT_TABLES, OCR_TABLES):
        assert table_regions(lines, lambda r: r.level > 0, rules) == regions(lines, lambda r: r.level > 0, rules)


def test_continuation_rows_and_escapes():
    rows = [line(9, (10, "Name"), (200, "Note")), line(8, (10, "a|b"), (200, "first")), line(7, (200, "second")), line(6, (10, ""), (200, ""))]
    assert pipe_table(rows, [10, 200], TEXT_TABLES, merge=True) == "| Name | Note |\n| --- | --- |\n| a\\|b | first second |\n|  |  |"
    assert pipe_table(rows[:1], [10, 200], TEXT_TABLES, merge=True) is None


def test_page_blocks():
    lines = [
        line(700, (72, "Big"), h=20, level=1), line(680, (72, "Title"), h=20, level=1), line(650, (72, "body of the self-")), line(638, (72, "defense is hyphen-")), line(626, (72, "ated")),
        line(600, (72, "• point")), line(588, (72, "(a) item")), line(576, (72, "7"), (100, "note"), marker="7", marked="note"), line(500, (72, "far below")),
    ]
    assert page_markdown(lines, 10.0, extended=False) == "# Big Title\n\nbody of the self- defense is hyphenated \n\n- point\n1. item\n7. note\nfar below"
    assert "selfdefense" in page_markdown(lines, 10.0, extended=False, hyphens=False)


def test_items_become_pages(spark):
    items = [
        (1, 0, 0, "Header", 72.0, 780.0, 10.0), (1, 0, 1, "Second", 130.0, 700.0, 10.0), (1, 0, 2, "First", 72.0, 702.0, 10.0), (1, 0, 3, "below", 72.0, 690.0, 10.0), (1, 1, 0, "Footer only", 72.0, 10.0, 10.0),
    ]
    df = spark.createDataFrame(items, "doc_id long, page_no int, item_idx int, str string, x double, y double, height double").withColumns({"page_width": F.lit(612.0), "page_height": F.lit(792.0)})
    got = {r.page_no: r.markdown for r in render_pages(lines_of_items(df, ConvertOptions()), ConvertOptions()).collect()}
    assert got == {0: "First Second below", 1: "Footer only"}


def test_columns_can_be_respected(spark):
    items = [(1, 0, 2 * k + s, f"{'LR'[s].lower()}{k}", 72.0 if s == 0 else 400.0, 700.0 - 12 * k, 10.0) for k in range(10) for s in (0, 1)] + [(1, 0, 99, "gutter", 306.0, 640.0, 10.0)]
    df = spark.createDataFrame(items, "doc_id long, page_no int, item_idx int, str string, x double, y double, height double").withColumns({"page_width": F.lit(612.0), "page_height": F.lit(792.0)})
    merged = lines_of_items(df, ConvertOptions()).orderBy("line_no").collect()
    assert merged[0].text == "l0 r0" and len(merged) == 10 and "gutter" not in [r.text for r in merged]
    apart = lines_of_items(df, ConvertOptions(respect_columns=True)).orderBy("line_no").collect()
    assert [r.text for r in apart] == [f"l{k}" for k in range(10)] + [f"r{k}" for k in range(10)]


def test_ruled_cells_and_their_region():
    words = [("a", 15.0, 15.0), ("b", 55.0, 15.0), ("|", 15.0, 15.0), ("c", 15.0, 45.0), ("edge", 90.0, 15.0), ("out", 200.0, 15.0)]
    grid = ocr.ruled_cells(words, [10.0, 30.0, 60.0], [10.0, 50.0, 90.0])
    assert grid == [["a", "b"], ["c", " "]]
    page = ocr.ocr_page_markdown([line(90, (10, "before")), line(80, (10, "in")), line(70, (10, "in too")), line(60, (10, "EXHIBIT A")), line(50, (10, "3. x"))], [5, 20, 40, 70, 80], (grid, 10.0, 60.0))
    assert page == "before\n\n| a | b |\n| --- | --- |\n| c |   |\n\n## EXHIBIT A\n\n3. x"


def test_items_and_words_are_dealt_once_over_partitions_that_grow_with_the_table(spark, sf, monkeypatch):
    import re

    from parchmint.catalogue import QUERIES
    from parchmint.plans import views

    items, words = views.items(spark, sf).count(), views.typeset(spark, sf).count()
    monkeypatch.setattr(layout, "DEALT_ITEMS", 500)
    assert views.items(spark, sf).rdd.getNumPartitions() == -(-items // 500)
    assert views.typeset(spark, sf).rdd.getNumPartitions() > words // 1000
    for name in ("two_column_flag", "line_stats", "table_interval_join", "table_regions", "page_layout_full"):
        df = QUERIES[name](spark, sf)
        df.collect()
        dealt = re.findall(r"Exchange hashpartitioning\(([^\n]*)", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt), name


def test_pages_made_from_a_small_file_are_dealt_out(spark, sf, monkeypatch):
    from parchmint.plans import html_queries, queries

    monkeypatch.setattr(layout, "DEALT_ITEMS", 300)
    assert queries._drawn(spark, sf)[0].rdd.getNumPartitions() > 8
    seen = []
    monkeypatch.setattr(html_queries, "blocks_to_markdown", lambda pages, key: seen.append(pages.rdd.getNumPartitions()) or pages)
    html_queries.made_markdown(spark, sf)
    assert seen[0] > 8


def test_recognised_pages_are_read_and_dealt_once(spark, sf):
    from parchmint.catalogue import QUERIES

    df = QUERIES["ocr_page_full"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan") == 1 and "Join" not in plan


def test_a_word_without_a_box_stands_in_no_cell(spark):
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    schema = f"doc_id long, page_no int, scale double, text string, lines array<struct<line_no:long,y:double,y_mid:double,h:double,text:string,xs:array<double>,words:array<struct<text:string,x:double>>>>, words array<struct<text:string,bbox:{box}>>, h_lines array<double>, v_lines array<double>"
    line = (0, 90.0, 15.0, 10.0, "a", [15.0], [("a", 15.0)])
    words = [("a", (45, 45, 45, 45)), ("lost", None), ("half", (45, None, 45, 45)), (None, (45, 45, 45, 45)), ("b", (165, 135, 165, 135))]
    rows = [
        (1, 1, 3.0, None, [line], words, [10.0, 30.0, 60.0], [10.0, 50.0, 90.0]), (2, 1, 3.0, " plain ", None, None, None, None), (3, 1, 3.0, "x", [line], None, [10.0, 30.0], [10.0, 50.0]),
        (4, 1, 3.0, "x", [line], words, [10.0, 30.0], None), (5, 1, 3.0, "x", [line], words, [], [10.0, 50.0]), (6, 1, 3.0, None, [], [], None, None),
    ]
    got = {r.doc_id: (r.markdown, r.error) for r in ocr.render_ocr_pages(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
    assert got == {1: ("| a |   |\n| --- | --- |\n|   | b |", None), 2: ("plain", None), 3: ("|   |\n| --- |", None), 4: ("a", None), 5: ("a", None), 6: ("", None)}


def test_rules_of_recognised_words_and_lines_equal_the_plain_ones(spark):
    texts = ["", " ", " ", "|", " | ", " [\n", "]", "||", "| |", "[a", "a", " a ", "﻿", "| |", "\n", "-", "abcd", "abcde", "Abcd", "\U0001d4d0", "a\n\n\n", "a\n\n\n\n", "a\U0001d4d0\U0001d4d0\U0001d4d0", None]
    df = spark.createDataFrame([(i, t, c) for i, t in enumerate(texts) for c in (4.0, 5.0, None)], "i int, text string, confidence double")
    word = F.col("text")
    trimmed = F.regexp_replace(word, rf"^{ocr.WS}+|{ocr.WS}+\z", "")
    plain = (trimmed != "") & (F.col("confidence") >= 5) & ~trimmed.isin("|", "[", "]")
    stands = (word != "") & ~((F.length(word) <= 4) & word.rlike("^[a-z]"))
    good = F.size(ocr.good_words(F.array(F.struct("text", "confidence")))) == 1
    rows = df.select("text", good.alias("good"), F.coalesce(plain, F.lit(False)).alias("plain"), ocr._stands(word, F.lit(50.0), F.lit(100.0)).alias("stands"), stands.alias("stood")).collect()
    assert all(r.good == r.plain and r.stands == r.stood for r in rows) and {r.good for r in rows} == {r.stands for r in rows} - {None} == {True, False}


@given(st.text(st.sampled_from("aZ É1|\n"), max_size=8))
def test_capitals_are_three_letters_or_more(text):
    letters = [c for c in text if c in "aZ"]
    assert ocr._caps(text) == (len(letters) >= 3 and "a" not in letters)


def test_values_of_batches_equal_those_of_arrow():
    import pyarrow as pa

    from parchmint.functions.batches import fields, lists, values

    kind = pa.list_(pa.struct([("n", pa.int32()), ("x", pa.float64()), ("t", pa.string()), ("b", pa.bool_())]))
    rows = [[{"n": 1, "x": 0.5, "t": "é", "b": True}, None], None, [], [{"n": None, "x": None, "t": None, "b": None}], [{"n": 7, "x": 2.0, "t": "", "b": False}]]
    for column in (pa.array(rows, kind), pa.array(rows, kind).slice(1), pa.array(rows, kind).slice(4, 1), pa.array([None], kind), pa.array([], kind)):
        plain = [None if r is None else [tuple(e.values()) if e else (None,) * 4 for e in r] for r in column.to_pylist()]
        got = lists(column, lambda found: fields(found, "n", "x", "t", "b"))
        assert got == plain and [type(v) for r in got for e in r or [] for v in e] == [type(v) for r in plain for e in r or [] for v in e]
    assert values(pa.array([1, 2], pa.int64())) == [1, 2] and values(pa.array([None, 2], pa.int64())) == [None, 2]


def test_a_page_of_text_without_tables_asks_for_few_distances():
    class Counted(float):
        asked = 0

        def __sub__(self, other):
            Counted.asked += 1
            return float(self) - other

    lines = [line(780 - 14 * k, *[(Counted(72 + 36 * w), "w") for w in range(60)]) for k in range(40)]
    assert table_regions(lines, lambda r: False, TEXT_TABLES) == [] and Counted.asked < 20_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0.1, 0.7, 10.3, 36.6, 72.2, 100.1, 130.9, 200.4]), max_size=6), max_size=8))
def test_table_regions_of_fractions_and_empty_lines_equal_the_plain_rule(shape):
    lines = [line(500 - 12 * k, *[(x, "c") for x in sorted(xs)], level=k % 5 // 4) for k, xs in enumerate(shape)]
    for rules in (TEXT_TABLES, OCR_TABLES):
        assert table_regions(lines, lambda r: r.level > 0, rules) == regions(lines, lambda r: r.level > 0, rules)


def test_page_layout_sorts_its_items_three_times(spark, sf):
    from parchmint.catalogue import QUERIES

    df = QUERIES["page_layout_full"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count(" Sort [") == 3 and plan.count("Exchange hashpartitioning") == 1  # into lines, by height, into lines again


def test_reading_order_counts_zones_within_the_margins(spark):
    def page(no, items):
        return [(1, no, i, "w", float(x), float(y), 10.0) for i, (x, y) in enumerate(items)]

    both = [(x, 700 - 12 * k) for k in range(9) for x in (72, 400)]
    rows = [
        *page(0, [*both, (306, 500)]),  # two columns: the gutter goes
        *page(1, [*both[2:], (72, 790), (400, 10), (306, 500)]),  # eight on either side within the margins: it stays
        *page(2, [(x, 790) for x, _ in both] + [(306, 10)]),  # nothing within them: all count, the gutter goes
        *page(3, [*both, *[(306, 790 + k) for k in range(9)], (306, 500)]),  # margins add nothing to the gutter
    ]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, item_idx int, str string, x double, y double, height double").withColumns({"page_width": F.lit(612.0), "page_height": F.lit(792.0)})
    plain = layout.column_zones(layout.strip_margins(df), F.col("page_width")).where("NOT (two_columns AND zone = 'mid')")
    want = sorted((r.page_no, r.item_idx) for r in plain.collect())
    got = layout.reading_order(df).collect()
    assert sorted((r.page_no, r.item_idx) for r in got) == want and [sum(p == no for p, _ in want) for no in range(4)] == [18, 17, 18, 18]
    first = sorted((r for r in got if r.page_no == 0), key=lambda r: r.read_pos)
    assert [(r.x, r.y) for r in first] == [(x, 700.0 - 12 * k) for x in (72.0, 400.0) for k in range(9)]


def test_blanks_are_told_and_collapsed_as_before(spark):
    from itertools import product

    from parchmint.functions.text import BLANKS, WS, collapse

    texts = ["".join(t) for n in range(5) for t in product("a \t\xa0", repeat=n)] + [f"{b}{c}a{b} {c}" for b in BLANKS for c in "\u200b\x1c "] + list(BLANKS) + ["\x1c", "\u200b", "\u3000\ufeff ", "\u180e", "é", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, str string")
    plain = F.trim(F.regexp_replace("str", f"{WS}+", " "))
    assert all(r.a == r.b for r in df.select(collapse(F.col("str")).alias("a"), plain.alias("b")).collect())
    inked = df.where(F.regexp_replace(F.coalesce("str", F.lit("")), f"{WS}+", "") != "")
    assert [r.i for r in layout.printable(df).orderBy("i").collect()] == [r.i for r in inked.orderBy("i").collect()]
