"""Scalar rules by truth table, and the gates of files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.functions.unicode import nfc
from parchmint.operators import gates, integrity
from parchmint.operators.audits import audit
from parchmint.operators.export import export_names, write_markdown, zip_archives
from parchmint.operators.preferences import load_preferences, stored_preferences
from parchmint.options import PDF_ERRORS, TRUNCATED, ConvertOptions, Limits


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_error_classes(spark):
    cases = [
        ("No password given", "", "password"), ("Encrypted file", "", "password"), ("", "PasswordException", "password"), ("Invalid PDF structure", "", "corrupt"), ("corrupt xref", "", "corrupt"),
        ("Malformed", "", "corrupt"), ("", "InvalidPDFException", "corrupt"), ("out of memory", "", "memory"), ("something", "", "other"), (None, None, "other"),
    ]
    df = spark.createDataFrame([(i, m, n) for i, (m, n, _) in enumerate(cases)], "i int, m string, n string")
    got = [r.o for r in df.select("i", T.classify_error(F.col("m"), F.col("n")).alias("o")).orderBy("i").collect()]
    assert got == [PDF_ERRORS[c] for _, _, c in cases]


def test_links(spark):
    cases = {
        "[a](javascript:x)": "[a]()", "[a](JavaScript:x)": "[a]()", "[a]( javascript:x)": "[a]()", "[a](data:text/html,x)": "[a]()", "[a](data:image/png,x)": "[a](data:image/png,x)",
        "[a](https://b.c)": "[a](https://b.c)", "[x](javascript:alert(1))": "[x]())", "no link": "no link", "[](javascript:x)": "[]()", "[a](javascript:x) [b](javascript:y)": "[a]() [b]()", "[a](mailto:b@c)": "[a](mailto:b@c)",
    }
    assert apply(spark, T.sanitize_links, list(cases)) == list(cases.values())


def test_names_sizes_and_spaces(spark):
    assert apply(spark, T.sanitize_filename, ["a\x00b/c d", "  x   y ", "", None, "é.pdf", "z" * 300]) == ["ab_c d", "x y", "document", "document", "_.pdf", "z" * 200]
    assert apply(spark, T.name_without_ext, ["a.pdf", "a.DOCX", "a.pdf.txt", "a.pdf\n"]) == ["a", "a", "a.pdf.txt", "a.pdf\n"]
    assert apply(spark, T.format_size, [0, 1023, 1536, 1048576, 2359296], "long") == ["0 KB", "1 KB", "2 KB", "1.0 MB", "2.3 MB"]
    assert apply(spark, T.collapse, [" a \t﻿ b\n", "", None]) == ["a b", "", None]
    assert apply(spark, T.blockquote, ["a\n\nb"]) == ["> a\n> \n> b"]
    assert apply(spark, nfc, ["é", "abc", None]) == ["é", "abc", None]
    assert apply(spark, lambda c: T.truncate(c, 3), ["abcd", "abc"]) == ["abc" + TRUNCATED, "abc"]


def test_markers_and_hyphens(spark):
    got = apply(spark, T.list_marker, ["• a", "- b ", "1. c", "(iv) d", "1.e", "text"])
    assert [tuple(g) for g in got] == [("ul", "a"), ("ul", "b "), ("ol", "c"), ("ol", "d"), (None, None), (None, None)]
    assert apply(spark, T.hyphen_stem, ["the Self-", "no", "a 1-", "x-"]) == ["self", None, None, "x"]
    assert apply(spark, T.keeps_hyphen, ["self", "house"]) == [True, False]
    assert apply(spark, T.all_caps, ["ABC 1", "AB", "ABc", ""]) == [True, False, False, False]


@pytest.mark.parametrize(
    ("text", "h", "level"),
    [
        ("Title", 13.5, 1), ("II. Facts", 10.5, 2), ("3. Terms", 11.25, 2), ("3. Terms", 11.1, 3), ("exhibit a", 10.5, 2), ("INTRODUCTION", 10.3, 2), ("A. Sub", 10.0, 3),
        ("plain", 12.2, 2), ("plain", 11.0, 3), ("plain", 10.9, 0), ("", 30.0, 0),
    ],
)
def test_heading_rules(spark, text, h, level):
    df = spark.createDataFrame([(text, h, 10.0)], "t string, h double, m double")
    assert df.select(T.heading_level(F.col("t"), F.col("h"), F.col("m")).alias("o")).first().o == level


def test_file_gates(spark):
    assert apply(spark, gates.sniff, [bytearray(b"%PDF-1.7"), bytearray(b"PK\x03\x04zz"), bytearray(b"%P"), bytearray(b"")], "binary") == ["pdf", "zip", None, None]
    assert apply(spark, lambda c: gates.size_status(c), [52428800, 52428801], "long") == ["queued", "size-exceeded"]
    assert apply(spark, lambda c: gates.page_status(c), [2000, 2001], "int") == [None, "page-exceeded"]
    assert apply(spark, lambda c: gates.soft_warning(c), [500, 501, 2001], "int") == [False, True, False]
    assert ConvertOptions().limits == Limits() and Limits().max_files == 50


def test_manifest_round_trip(spark, tmp_path):
    files = spark.createDataFrame([('/b"x', bytearray(b"1")), ("/a", bytearray(b"2")), ("/skip", bytearray(b"3"))], "path string, content binary")
    built = integrity.manifest_json(integrity.digests(files), "1", "u", exclude=files.where("path = '/skip'").select("path")).first().manifest
    (tmp_path / "m.json").write_text(built)
    read = integrity.read_manifest(spark, str(tmp_path / "m.json"))
    assert [r.path for r in read.collect()] == ["/a", '/b"x']
    report = integrity.verify_report(integrity.verify(read, integrity.digests(files))).first()
    assert (report.n_ok, report.n_bad, report.all_match, report.mismatched) == (2, 0, True, "")
    empty = integrity.verify_report(integrity.verify(read.limit(0), integrity.digests(files))).first()
    assert (empty.n_ok, empty.all_match) == (0, False)


def test_archives_of_exports(spark):
    import io
    import zipfile

    docs = spark.createDataFrame([(1, "b", "a", "one"), (2, "b", "a", "two"), (3, "b", "c", None)], "file_ord int, batch string, sanitized_name string, markdown string")
    named = export_names(docs, batch=["batch"])
    found = {}
    for r in zip_archives(named, "batch").collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.archive))) as z:
            found |= {n: z.read(n).decode() for n in z.namelist()}
    assert found == {"a.md": "one", "a (2).md": "two", "c.md": ""}


def test_markdown_files_have_their_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "one"), (2, "a", "two é"), (3, "x/y", None)], "file_ord int, sanitized_name string, markdown string")
    written = {r.entry_name: r.bytes for r in write_markdown(export_names(docs), str(tmp_path / "out")).collect()}
    assert written == {"a.md": 3, "a (2).md": 6, "x/y.md": 0}
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.md": "one", "a (2).md": "two é", "x_y.md": ""}


def test_preferences(spark):
    rows = [("a", "lang", "fra"), ("a", "ocr", "true"), ("a", "hyphens", "1"), ("b", "lang", "xyz"), ("b", "extended", "false"), ("b", "normalize", "yes"), ("c", "other", None)]
    got = {r.session: r.asDict() for r in load_preferences(spark.createDataFrame(rows, "session string, key string, value string")).collect()}
    assert got["a"] == {"session": "a", "lang": "fra", "ocr": True, "extended": True, "normalize": True, "hyphens": True}
    assert got["b"] == {"session": "b", "lang": "eng", "ocr": False, "extended": False, "normalize": True, "hyphens": True} and got["c"]["lang"] == "eng"
    again = load_preferences(stored_preferences(spark.createDataFrame([("z", "deu", True, False, True, False)], "session string, lang string, ocr boolean, extended boolean, normalize boolean, hyphens boolean"))).first()
    assert (again.lang, again.ocr, again.extended, again.normalize, again.hyphens) == ("deu", True, False, True, False)


def test_audit_reports_lines_and_rules(spark):
    lines = spark.createDataFrame([(0, "  eval(x); e.innerHTML = y"), (1, "e.innerHTML = ''"), (2, "go https://h/" + "p" * 100), (3, "import(`/x`)")], "line_no int, line string")
    got = [(r.line_no, r.rule, r.shown) for r in audit(lines).collect()]
    assert [g[:2] for g in got] == [(0, "eval is called"), (0, "markup is only cleared"), (2, "no remote addresses"), (3, "imports come from the vendored files")]
    assert got[0][2] == "line 1: eval(x); e.innerHTML = y" and len(got[2][2]) == len("line 3: ") + 80


def test_activity_log_is_appended(spark, tmp_path):
    from parchmint.streaming.watch import activity

    spark.sql("SELECT timestamp'2024-01-01 10:02:03.456' AS ts, 'begun' AS msg, 'info' AS level").write.json(str(tmp_path / "in"))
    entries = spark.readStream.schema("ts timestamp, msg string, level string").json(str(tmp_path / "in"))
    activity(entries, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [(r.msg, r.shown) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("begun", "02:03.456")]


@pytest.mark.parametrize("name", ["nfc_normalize", "html_to_markdown"])
def test_python_takes_batches_of_bounded_bytes(spark, sf, name):
    from parchmint import catalogue
    from parchmint.functions.batches import BATCH_BYTES

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.unset(setting)
    try:
        catalogue.QUERIES[name](spark, sf)
        assert 0 < int(spark.conf.get(setting).removesuffix("b")) <= BATCH_BYTES
    finally:
        spark.conf.set(setting, before)
