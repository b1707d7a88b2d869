from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parchmint.llm import queries, quality_rules
from parchmint.llm.labelled import labelled_sample
from tests.llm.conftest import AWKWARD
from tests.llm.test_lines_and_pages import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_secrets_and_prints import base
from tests.llm.test_tokens import check_packed


@pytest.fixture(scope="module")
def staged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_equal_brute_force(spark, sf, staged):
    docs, good, thin, single, safe, packed = staged
    for df in (good, thin, single, safe):
        assert df.columns == docs.columns
    model = quality_rules.fit(labelled_sample(docs, spark.read.parquet(f"{sf}/labels.parquet"), quality_rules.SAMPLE_ROWS))
    all_ = rows(docs)
    p = dict(zip(all_, quality_rules.probabilities(pa.array([r.text for r in all_.values()]), model), strict=True))
    keep = set()
    for i, r in all_.items():
        n, _, _, _, repeated = brute_counts(r.text)
        if n >= 20 and 100 * repeated <= 30 * n and p[i] >= quality_rules.KEEP_AT:
            keep.add(i)
    assert set(rows(good)) == keep and all(rows(good)[i] == all_[i] for i in keep)

    lines = brute_lines([(i, r.text, r.source) for i, r in rows(good).items()], 5)
    left = {i: t for i, t in lines.items() if t == all_[i].text or t.strip(" \t\n\x0b\x0c\r")}
    assert {i: (r.text, r.n_chars) for i, r in rows(thin).items()} == {i: (t, len(t)) for i, t in left.items()}

    ids = sorted(left)
    label = brute_near([left[i] for i in ids], 5)
    first = {i for k, i in enumerate(ids) if label[k][1] == k}
    assert set(rows(single)) == first

    for i, r in rows(safe).items():
        before = left[i]
        spans = base(before)
        if not spans:
            assert r.text == before or "[SECRET]" in r.text
        assert not base(r.text) and r.n_chars == len(r.text)
    check_packed([r for r in packed.withColumnRenamed("doc_id", "id").collect()], safe.collect())


def test_run_and_queries_are_registered(spark, sf, staged):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {"pipeline", *queries.QUERIES} <= set(names) and len([n for n in names if n.startswith("op")]) >= 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    got = {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {(r.doc_id, r.doc_tokens) for r in staged[-1].collect()}


def test_run_on_awkward_rows_and_on_none(spark, sf, tmp_path):
    """Null, empty, blank, long, repeated and clashing rows go through all stages; an empty table gives no rows."""
    given = spark.read.parquet(f"{sf}/documents.parquet")
    good = given.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").limit(30)
    clash = ["lang", "source", "n_chars"]
    extra = {"id": F.lit("x"), "n": F.lit(1), "kept": F.lit(False), "label": F.lit("y"), "component": F.lit(3), "probability": F.lit(0.5), "spans": F.lit("s")}
    texts = [*AWKWARD, "plain words " * 30, "plain words " * 30]
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)] + [(None, "no id " * 40)], "doc_id long, text string")
    odd = odd.select("*", *[F.lit(None).cast(dict(given.dtypes)[c]).alias(c) for c in clash])
    docs = given.unionByName(good).unionByName(odd).withColumns(extra)
    for name, df in (("docs", docs), ("none", docs.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
    out = spark.read.parquet(str(tmp_path / "docs" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path / "docs"))
        assert out.columns == docs.columns
        out = out.cache()
        assert {r.id for r in out.select("id").distinct().collect()} <= {"x"}
    rows = out.collect()
    assert not [r for r in rows if r.text is None or not r.text.strip()] and {r.kept for r in rows} == {False}
    packed = corpus_pipeline.run(spark, str(tmp_path / "docs")).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
