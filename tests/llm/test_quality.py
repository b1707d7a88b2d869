from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parchmint.llm import quality_model, quality_rules
from tests.llm.conftest import AWKWARD

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for j, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(j, j + 8))
    seen, repeated = set(), 0
    for line in t.split("\n"):
        repeated += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), repeated, len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(3)
    texts = [*AWKWARD, *(" ".join(rng.choice("abc|#") for _ in range(rng.randrange(60))) for _ in range(60)), "a b c d e f g h a b c d e f g h", "x\n\nx\n \n y\ny"]
    got = quality_rules.counts(pa.array(texts))
    for i, t in enumerate(texts):
        own = tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols")) + (quality_rules.repeated_lines(t or ""), int(got["n_repeat_words"][i]))
        assert own == brute(t), t


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def area(p, y):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_regression_parts_unseen_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = labels.where("doc_id % 2 = 1")
    rows = quality_rules.quality_rules(docs, docs, odd).join(labels.where("doc_id % 2 = 0"), quality_rules.F.col("id") == labels.doc_id).collect()
    p, y = np.array([r.probability for r in rows]), np.array([r.quality for r in rows])
    kept = np.array([r.kept for r in rows])
    assert area(p, y) > 0.9 and kept[y == 1].mean() > 0.9 and kept[y == 0].mean() < 0.5


def test_rules_on_awkward_rows(spark, awkward, empty, tables):
    docs, labels = tables
    rows = quality_rules.quality_rules(awkward, docs, labels, carry=["text", "lang", "n", "kept"]).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.lang == "en" and 0 <= r.probability <= 1 and (r.n_words >= 20 or r.base_failed)
    assert quality_rules.quality_rules(empty, docs, labels).count() == 0
    assert quality_rules.quality_rules(awkward, docs, labels.limit(0)).where("probability <> 1").count() == 0


def test_scores_are_held_out_and_part_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_model.quality_scores(docs, labels).where("held_out").join(labels, quality_model.F.col("id") == labels.doc_id).collect()
    assert all(zlib.crc32(str(r.id).encode()) % 4 == 2 for r in rows)
    p, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert area(p, y) > 0.95 and ((p >= 0.7) == y).mean() > 0.95
    confident = (p > 0.9) | (p < 0.1)
    assert abs(p[confident].mean() - y[confident].mean()) < 0.03


def test_scores_of_awkward_rows(awkward, empty, tables):
    docs, labels = tables
    rows = quality_model.quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.id in (0, 1, 2)}) == 1
    assert quality_model.quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_model.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_pooling_does_not_depend_on_the_batch():
    vectors = quality_model.index_vectors()
    texts = ["a B c", None, "The The The", "x" * 10, " ".join(f"w{i}" for i in range(200_000))]
    whole = quality_model.pooled(pa.array(texts), vectors)
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality_model.pooled(pa.array([t], pa.string()), vectors)[0], atol=1e-5)


def test_word_vectors_and_scores_equal_plain_loops():
    """Random indexing, pooling and the network, each once more without arrays over batches."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["one", "two", "Three", "four!", "x9", "the"]) for _ in range(rng.randrange(40))) for _ in range(30)] + ["", " ", "lone"]
    column = pa.array(texts)
    index = quality_model.index_vectors()
    own, shape, at = quality_model.buckets(column)
    context = {}
    for i in range(len(texts)):
        for words in (own[at[i] : at[i + 1]].tolist(), shape[at[i] : at[i + 1]].tolist()):
            for a in range(len(words)):
                for b in range(max(0, a - 2), min(len(words), a + 3)):
                    if a != b:
                        context[words[a]] = context.get(words[a], 0) + index[words[b]].astype(np.float64)
    vectors = quality_model.word_vectors([column.slice(0, 11), column.slice(11)], index)
    for word in {*own.tolist(), *shape.tolist()}:
        mine = context.get(word, np.zeros(quality_model.DIMENSIONS))
        assert np.allclose(vectors[word], index[word] + mine / max(np.linalg.norm(mine), 1e-9), atol=1e-5)
    labels = [int("the" in t) for t in texts]
    model = quality_model.fit(pa.table({"text": texts, "label": labels}), rounds=20)
    got = quality_model.scores(column, model)
    for i in range(len(texts)):
        some = [(own[k], shape[k]) for k in range(at[i], at[i + 1])]
        x = np.concatenate([sum((model["vectors"][s[j]] for s in some), np.zeros(quality_model.DIMENSIONS)) / max(len(some), 1) for j in (0, 1)])
        z = sum(max(0.0, float(sum((x[d] - model["mean"][d]) / model["scale"][d] * model["w1"][d, h] for d in range(len(x))) + model["b1"][h])) * model["w2"][h] for h in range(len(model["b1"]))) + model["b2"][0]
        assert abs(got[i] - 1 / (1 + np.exp(-z / model["temperature"]))) < 1e-4


def test_the_fit_reads_2500_labelled_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_rules, "fit", lambda sample: seen.append(sample.num_rows))
    docs = spark.range(2600).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    quality_rules.quality_rules(docs, docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality"))
    assert seen == [2500]


def test_parts_of_the_sample_fit_as_the_whole(monkeypatch):
    rng = random.Random(9)
    text = [" ".join(rng.choice(["good", "fine", "well"] if i % 2 else ["spam", "win", "cash"]) + str(rng.randrange(30)) for _ in range(12)) for i in range(230)]
    sample = pa.table({"id": range(230), "text": text, "label": [i % 2 for i in range(230)]})
    monkeypatch.setattr(quality_rules, "PART_ROWS", 1000)
    whole = quality_rules.fit(sample)
    monkeypatch.setattr(quality_rules, "PART_ROWS", 70)
    parts = quality_rules.fit(sample)
    assert np.allclose(whole["weights"], parts["weights"], atol=1e-4) and abs(whole["slope"] - parts["slope"]) < 1e-3 * abs(whole["slope"])
