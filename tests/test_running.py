"""State kept in streams, running conversions, time budgets, and sinks that commit."""

from __future__ import annotations

import io
import itertools
import random
import time
import zipfile
from collections import Counter, defaultdict
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchmint.operators.deadlines import OutOfTime, within
from parchmint.operators.export import StagedFiles, export_names, located, write_markdown, zip_archives
from parchmint.operators.gates import capped
from parchmint.operators.layout import assemble, assemble_within
from parchmint.operators.page_layout import lines_of_items, render_pages
from parchmint.options import TIMED_OUT, ConvertOptions, Limits
from parchmint.plans.convert import convert_files
from parchmint.plans.running import Conversion
from parchmint.plans.sql_surface import register
from parchmint.plans.stream_queries import run_to_end
from parchmint.sources import committed
from parchmint.sources.pdf import read_pdf, read_pdfs
from parchmint.sources.scratch import Scratch
from parchmint.streaming.states import TRANSITIONS, capped_stream, file_states, final_states
from parchmint.streaming.watch import FolderProgress, convert_folder
from tests.test_files import pdf

def made(pages):
    return pdf([f"BT /F1 12 Tf 72 700 Td ({text}) Tj ET" for text in pages])


EVENTS = "id string, at timestamp, seq long, event string, page int, pages int, error string"
LIMIT = Limits(max_conversion_ms=60_000)


def made_events(n=400, seed=1):
    rng = random.Random(seed)
    names = [*TRANSITIONS, "page", "cancel", "nonsense"]
    weights = [8 if x in ("add", "start", "complete", "page", "recognise") else 1 for x in names]
    rows, now = [], 1_700_000_000.0
    for i in range(n):
        now += rng.choice([0.0, 0.5, 3.0, 20.0])
        rows.append((f"f{rng.randrange(25)}", datetime.fromtimestamp(now, timezone.utc), i, rng.choices(names, weights)[0], rng.randrange(1, 9), 8, "boom"))
    return rows


def folded(rows, limit_ms):
    """The same records, one event after another."""
    status, since, out = {}, {}, defaultdict(list)
    last = max(r[1].timestamp() for r in rows) * 1000
    for name, at, _, event, page, pages, error in sorted(rows, key=lambda r: (r[1], r[2])):
        ms, was = round(at.timestamp() * 1000), status.get(name)
        if was in ("converting", "ocr") and ms >= since[name] + limit_ms:
            out[name].append((since[name] + limit_ms, "failed", None, TIMED_OUT))
            was = status[name] = "failed"
        if event == "cancel" and was:
            status[name] = "cancelled" if was in ("converting", "ocr") else None
            out[name].append((ms, status[name] or "removed", None, None))
        elif event == "page" and was in ("converting", "ocr"):
            out[name].append((ms, was, int(page / pages * 90 + 0.5), None))
        elif event in TRANSITIONS and was in TRANSITIONS[event][0]:
            now = status[name] = TRANSITIONS[event][1]
            if now == "converting":
                since[name] = ms
            out[name].append((ms, now, 0 if now == "converting" else 100 if now in ("complete", "no-text") else None, error if now == "failed" else None))
    for name, now in status.items():
        if now in ("converting", "ocr") and since[name] + limit_ms <= last:
            out[name].append((since[name] + limit_ms, "failed", None, TIMED_OUT))
    return sorted((name, k, *r) for name, some in out.items() for k, r in enumerate(some, 1))


def put(spark, rows, folder, parts):
    """Rows as so many files, whose order is that of the rows."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], EVENTS).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)


def records(df):
    return sorted(((r.id, r.n, r.at_ms, r.status, r.progress, r.error) for r in df.collect()), key=lambda r: r[:2])


def test_states_are_the_same_for_any_split_and_after_a_restart(spark, tmp_path):
    rows = made_events()
    want = folded(rows, LIMIT.max_conversion_ms)
    assert any(r[5] == TIMED_OUT for r in want) and any(r[3] == "removed" for r in want)
    for parts in (1, 7):
        folder = f"{tmp_path}/events-{parts}"
        put(spark, rows, folder, parts)
        stream = file_states(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder), LIMIT)
        assert records(run_to_end(spark, stream, Scratch(spark, "states"), "records")) == want
    folder, scratch = f"{tmp_path}/restarted", Scratch(spark, "states")
    put(spark, rows[:170], folder, 2)
    for more in (None, rows[170:]):  # the second run goes on from the first one's checkpoint
        if more:
            put(spark, more, folder, 2)
        found = run_to_end(spark, file_states(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder), LIMIT), scratch, "records")
    assert records(found) == want
    last = {name: max(some, key=lambda r: r[1])[3] for name, some in itertools.groupby(want, key=lambda r: r[0]) for some in [list(some)]}
    assert {r.id: r.status for r in final_states(found).collect()} == {k: v for k, v in last.items() if v != "removed"}


def test_only_legal_transitions_leave_records(spark, tmp_path):
    at = datetime.fromtimestamp(1_700_000_000, timezone.utc)
    rows = [("a", at, i, e, None, None, None) for i, e in enumerate(["complete", "start", "add", "add", "complete", "start", "start", "complete", "fail", "requeue"])]
    rows += [(None, at, 90, "add", None, None, None), ("b", None, 91, "add", None, None, None), ("c", at, 92, None, None, None, None)]
    put(spark, rows, f"{tmp_path}/legal", 1)
    found = run_to_end(spark, file_states(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/legal"), LIMIT), Scratch(spark, "states"), "records")
    assert [(r[0], r[3]) for r in records(found)] == [("a", "queued"), ("a", "converting"), ("a", "complete")]


def test_a_session_is_capped_alike_in_any_split(spark, tmp_path):
    rng = random.Random(2)
    files = [(i, f"s{rng.choice([0, 0, 0, 1, 2])}", f"p{i:04d}") for i in range(300)]
    df = spark.createDataFrame(files, "at long, session string, path string")
    want = {(r.session, r.path, r.file_ord) for r in capped(df, "at", ["session"], 50).collect()}
    for parts in (1, 4, 11):
        folder, size = f"{tmp_path}/files-{parts}", -(-300 // parts)
        for i in range(parts):
            spark.createDataFrame(files[i * size : (i + 1) * size], df.schema).repartition(1).write.mode("append").parquet(folder)
            time.sleep(0.02)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        found = run_to_end(spark, capped_stream(stream, F.col("session"), F.col("at")), Scratch(spark, "cap"), "taken")
        assert {(r.session, r.path, r.file_ord) for r in found.collect()} == want
    assert Counter(s for s, _, _ in want)["s0"] == 50


def test_a_folder_is_capped_over_its_batches_and_tells_its_progress(spark, tmp_path):
    source = tmp_path / "in"
    for session in ("one", "two"):
        (source / session).mkdir(parents=True)
        for i in range(4):
            (source / session / f"f{i}[x].pdf").write_bytes(made([f"Page {p} of {i}" for p in range(1 + i)]))
            time.sleep(0.02)
    seen = FolderProgress()
    query = convert_folder(
        spark, f"file://{source}", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", ConvertOptions(limits=Limits(max_files=3)), per_trigger=3, session=F.element_at(F.split("path", "/"), -2), progress=seen
    )
    query.awaitTermination()
    begun = time.monotonic()
    while sum(b.files for b in seen.batches.values()) < 8 and time.monotonic() - begun < 20:  # events come by their own way
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    out = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert Counter(r.status for r in out) == {"complete": 6} and {r.name for r in out} == {f"f{i}[x].pdf" for i in range(3)}
    assert sum(b.pages_known for b in seen.batches.values()) == sum(b.pages_done for b in seen.batches.values()) == sum(r.pages for r in out) == 12
    assert sum(b.files for b in seen.batches.values()) == 8 and seen.percent() == 90


def endless(files, progress=None, **_):
    """A conversion whose tasks first write some rows and then never end."""

    def slow(batches):
        for batch in batches:
            yield batch
            while True:
                time.sleep(0.1)

    return files.select("path").repartition(2).mapInArrow(slow, "path string")


def test_a_cancelled_conversion_leaves_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(made(["text"]))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/in")
    target = f"file://{tmp_path}/target"
    run = Conversion(spark, files, target, convert=endless).start()
    begun = time.monotonic()
    while not list((tmp_path / "target").rglob("part-*")) and time.monotonic() - begun < 60:
        time.sleep(0.1)
    assert run.status == "converting"
    run.cancel()
    assert run.status == "cancelled" and run.wait() == "cancelled"
    assert not list(tmp_path.joinpath("target").rglob("part-*"))
    assert {r.status for r in run.records().collect()} == {"cancelled"} and run.records().count() == 4
    assert spark.range(10).count() == 10  # other work goes on


def test_a_conversion_counts_its_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(made([f"page {p}" for p in range(i + 2)]))
    (tmp_path / "in" / "bad.pdf").write_bytes(b"%PDF-1.4 nothing else")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/in")
    run = Conversion(spark, files, f"file://{tmp_path}/out").start()
    assert run.wait(120) == "complete" and run.progress() == 100
    done = [r for r in run.records().collect() if r.status == "complete"]
    assert run.pages_known == run.pages_done == sum(r.pages for r in done) == 9
    run.cancel()
    assert run.status == "complete"
    again = Conversion(spark, files, f"file://{tmp_path}/in").start()  # the target exists
    with pytest.raises(Exception):
        again.wait(60)


def test_budgets_end_work_and_nest():
    with pytest.raises(OutOfTime), within(50):
        while True:
            pass
    with within(10_000):
        with pytest.raises(OutOfTime), within(30):
            time.sleep(5)
        time.sleep(0.05)
    with pytest.raises(OutOfTime), within(120):
        with within(5_000):
            pass
        while True:
            pass
    with within(None):
        pass
    time.sleep(0.15)  # nothing rings afterwards


def test_an_endless_page_and_file_end_while_their_neighbours_come_out(spark, monkeypatch):
    rows = [(d, p, 0, f"text of {d} {p}", 50.0, 700.0, 100.0, 10.0, 612.0, 792.0) for d in range(2) for p in (1, 2)]
    items = spark.createDataFrame(rows, "doc_id long, page_no int, item_idx int, str string, x double, y double, width double, height double, page_width double, page_height double")
    options = ConvertOptions(limits=Limits(max_conversion_ms=300))

    lines = lines_of_items(items, options)
    stuck = lines.withColumn("xs", F.when((F.col("doc_id") == 1) & (F.col("page_no") == 1), F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.pmod(i.cast("long") * 7919, F.lit(300_007)).cast("double"))).otherwise(F.col("xs")))
    many = stuck.withColumn("line_no", F.explode(F.when(F.size("xs") > 1, F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))))
    out = {(r.doc_id, r.page_no): (r.markdown, r.error) for r in render_pages(many, options).collect()}
    assert out[1, 1] == (None, TIMED_OUT)
    assert all(out[k] == (f"text of {k[0]} {k[1]}", None) for k in out if k != (1, 1)) and len(out) == 4

    slow = made(["x"] * 30_000)
    files = spark.createDataFrame([("slow", slow), ("fine", made(["short"]))], "id string, content binary")
    read = {r.id: r.error_name for r in read_pdfs(files, max_ms=300).collect()}
    assert read == {"slow": "TimeoutException", "fine": None}


def test_markdown_files_commit_whole_or_not_at_all(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"name {i}", f"# {i}\n") for i in range(20)], "file_ord int, sanitized_name string, markdown string").repartition(4)
    out = tmp_path / "out"
    written = write_markdown(export_names(docs), f"file://{out}").collect()
    assert {r.entry_name: r.bytes for r in written} == {f"name {i}.md": len(f"# {i}\n") for i in range(20)}
    assert {p.name: p.read_text() for p in out.iterdir()} == {f"name {i}.md": f"# {i}\n" for i in range(20)}
    twice = spark.createDataFrame([("a/b.md", "1"), ("a_b.md", "2"), ("c.md", "3")], "entry_name string, markdown string")
    with pytest.raises(ValueError, match="2 documents"):
        write_markdown(twice, f"file://{tmp_path}/twice")
    assert not tmp_path.joinpath("twice").exists()
    assert located("/bare", "local[4]") == "file:///bare" and located("s3a://b/x", "yarn") == "s3a://b/x"
    with pytest.raises(ValueError, match="own disk"):
        located("/bare", "spark://host:7077")

    def broken(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("the task ends here")

    failing = export_names(docs).select("entry_name", "markdown").mapInArrow(broken, "entry_name string, markdown string")
    with pytest.raises(Exception, match="the task ends here"):
        write_markdown(failing, f"file://{tmp_path}/gone")
    assert not list(tmp_path.rglob("gone/**/*.md"))
    write_markdown(spark.createDataFrame([("name 1.md", "new"), ("more.md", None)], "entry_name string, markdown string"), f"file://{out}")
    assert (out / "name 1.md").read_text() == "new" and (out / "more.md").read_text() == "" and len(list(out.iterdir())) == 21


def test_a_write_that_fails_after_some_tasks_leaves_no_file(spark, tmp_path):
    """The sink by itself: one task of four fails each time, after it has staged its files."""
    spark.dataSource.register(StagedFiles)

    def broken(batches):
        from pyspark import TaskContext

        for batch in batches:
            yield batch
        if TaskContext.get().partitionId() == 3:
            raise RuntimeError("the task ends here")

    rows = spark.range(40).repartition(4).selectExpr("concat(id, '.md') AS entry_name", "concat(id, '.md') AS file", "'text' AS markdown")
    folder = committed.Folder(f"file://{tmp_path}/staged")
    with pytest.raises(Exception, match="the task ends here"):
        rows.mapInArrow(broken, "entry_name string, file string, markdown string").write.format("parchmint_files").mode("append").save(f"file://{tmp_path}/staged")
    assert committed.committed(folder) == [] and not list(tmp_path.rglob("*.md"))


def test_hot_names_are_numbered_in_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(5000) * 10, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([1, None])) for _ in range(4000)]
    rows = [(o + i % 10, n, b) for i, (o, n, b) in enumerate(rows)]
    docs = spark.createDataFrame(list({(o, n, b): None for o, n, b in rows}), "file_ord long, sanitized_name string, batch int")
    for batch in (None, ["batch"]):
        plain = export_names(docs, batch=batch).select("file_ord", "sanitized_name", "batch", "entry_name")
        hot = export_names(docs, batch=batch, hot_name=100).select("file_ord", "sanitized_name", "batch", "entry_name")
        key = lambda r: (r.sanitized_name or "", r.batch or 0, r.entry_name or "")
        one, two = ([key(r) for r in sorted(df.collect(), key=key)] for df in (plain, hot))
        assert one == two
    single = docs.dropDuplicates(["file_ord"])
    order = lambda df: sorted((r.file_ord, r.entry_name or "") for r in df.collect())
    assert order(export_names(single)) == order(export_names(single, hot_name=50))


def test_assembly_gathers_what_the_limit_needs(spark):
    link = "[x](javascript:alert('" + "y" * 40 + "'))"
    pages = [(1, p, f"page {p} " + "z" * 30) for p in range(200)]
    pages += [(2, p, link * 20) for p in range(60)] + [(3, 1, "short"), (3, 2, " "), (4, 1, None)]
    pages += [(5, p, "open [link" if p == 2 else "rest](javascript:x" if p == 3 else "w) " + "w" * 20) for p in range(90)]
    df = spark.createDataFrame(pages, "doc_id long, page_no int, markdown string").repartition(5)
    from parchmint.operators.gates import finish

    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    for limit in (60, 300, 100_000):
        limits = Limits(max_output_chars=limit)
        want = {r.doc_id: (r.markdown, r.status) for r in finish(assemble(df, name), limits).collect()}
        some = assemble_within(df, name, limit)
        assert {r.doc_id: (r.markdown, r.status) for r in finish(some, limits).collect()} == want
        if limit == 60:
            assert some.where("doc_id = 1").first().markdown.count("page ") <= 4


def test_ocr_without_recognised_pages_is_an_error(spark):
    with pytest.raises(ValueError):
        convert_files(spark.createDataFrame([], "path string, length long, content binary"), ConvertOptions(ocr=True))


def test_encryption_is_told_by_the_trailer_alone_and_unmapped_codes_are_errors():
    text = pdf(["BT /F1 12 Tf 72 700 Td (the word /Encrypt in a text) Tj ET"])
    _, items = read_pdf(text)
    assert items[0]["str"] == "the word /Encrypt in a text"
    with pytest.raises(PermissionError):
        read_pdf(text.replace(b"%%EOF", b"trailer << /Root 1 0 R /Encrypt 9 0 R >>\nstartxref\n0\n%%EOF"))
    with pytest.raises(PermissionError):
        read_pdf(text.replace(b"%%EOF", b"90 0 obj << /Type /XRef /Encrypt 9 0 R >>\nstream\nx\nendstream endobj\n%%EOF"))
    with pytest.raises(ValueError, match="no map"):
        read_pdf(pdf(["BT /F1 12 Tf 72 700 Td <00010002> Tj ET"]))


def test_archives_have_parts_of_their_size(spark):
    docs = spark.range(2500).selectExpr("CAST(id AS INT) AS file_ord", "IF(id < 2400, 'big', 'small') AS batch", "concat('d', id, '.md') AS entry_name", "concat('text ', id) AS markdown")
    found, sizes = {}, defaultdict(list)
    for r in zip_archives(docs, "batch", per_archive=300).collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.archive))) as z:
            sizes[r.batch].append(len(z.namelist()))
            found |= {n: z.read(n).decode() for n in z.namelist()}
    assert found == {f"d{i}.md": f"text {i}" for i in range(2500)}
    assert len(sizes["big"]) == 8 and max(sizes["big"]) < 400 and sizes["small"] == [100]


def test_sql_functions_tell_what_they_need(spark):
    register(register(spark))
    assert spark.sql("SELECT nfc('é') AS a, html_markdown('<h1>T</h1>') AS b, size_label(2097152) AS c, progress_percent(1, 8) AS d, file_kind(X'255044462D31') AS e, file_kind(NULL) AS f").first() == ("é", "# T", "2.0 MB", 11, "pdf", None)
    spark.range(1).selectExpr("1 AS doc_id", "1 AS page_no").createOrReplaceTempView("thin")
    with pytest.raises(Exception, match="lacks line_no"):
        spark.sql("SELECT * FROM page_tables(TABLE(thin))").collect()
    with pytest.raises(Exception, match="is a table"):
        spark.sql("SELECT * FROM page_tables(1)").collect()
