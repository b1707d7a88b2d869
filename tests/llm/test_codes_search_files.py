from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard

from parchmint.llm import lexical_search, token_files
from parchmint.llm.lexical_search import Block, bisected, search
from parchmint.llm.token_files import Builder, Damaged, File, read_tokens, write_tokens, written_and_read
from parchmint.llm.vector_codes import Tree, vector_codes
from parchmint.llm.word_tokens import tokenizer
from parchmint.sources import committed
from tests.llm.conftest import documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int, code string, id int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], VECTORS)


def coded(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry, without Spark and without a tree."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    whole = np.array([[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in rows], np.int64)
    size = whole.shape[1] // parts
    cut = [whole[:, p * size : (p + 1) * size] for p in range(parts)]
    books = [c[:entries].copy() for c in cut]

    def nearest(p):
        away = ((cut[p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
        return away.argmin(axis=1), away.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            which, _ = nearest(p)
            for e in set(which.tolist()):
                mine = cut[p][which == e]
                books[p][e] = mine.sum(axis=0) // len(mine)
    found = [nearest(p) for p in range(parts)]
    errors = sum(f[1] for f in found)
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors.tolist(), strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{f[0][k]:02x}" for f in found), int(errors[k]), by_label[label], sha) for k, (i, _, label) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_trees_give_the_lowest_of_equally_near_entries():
    rng = np.random.default_rng(3)
    for spread, size in ((3, 2), (1000, 5), (2, 16), (0, 3)):
        entries, points = rng.integers(-spread, spread + 1, (256, size)), rng.integers(-spread, spread + 1, (700, size))
        away = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        which, distance = Tree(entries).nearest(points)
        assert (which == away.argmin(axis=1)).all() and (distance == away.min(axis=1)).all()


def test_vector_codes_equal_a_plain_comparison(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got(vector_codes(df.repartition(3))) == coded(rows)


def test_vector_codes_of_awkward_rows(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.001 * i]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(300)]
    hot = [0.125] * 8
    rows += [(1000 + i, hot, 7) for i in range(200)] + [(5, rows[5][1], 1), (None, hot, None)]
    bad = [(2000, None, 1), (2001, [], 1), (2002, [None, *hot[1:]], 1), (2003, [float("nan"), *hot[1:]], 1), (2004, [float("inf"), *hot[1:]], 1), (2005, hot + hot, 1), (2006, hot[:4], 3)]
    assert got(vector_codes(vectors(spark, rows + bad).repartition(5))) == coded(rows)
    few = rows[:5]
    assert got(vector_codes(vectors(spark, few))) == coded(few)
    assert vector_codes(vectors(spark, [])).count() == 0 and vector_codes(vectors(spark, bad[:2])).count() == 0
    with pytest.raises(ValueError):
        vector_codes(vectors(spark, [(1, [0.5] * 6, 1)]))
    with pytest.raises(ArithmeticError):
        vector_codes(vectors(spark, [(1, [1e30] * 8, 1)]))


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top=20):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in docs]
    n, total, df = sum(x > 0 for x in lengths), sum(lengths), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, c), length in zip(docs, lengths, strict=True):
            if length:
                norm = 75 + (25 * length * n) // total
                score = sum(uses * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * norm)) for t, uses in Counter(terms(text)).items() if t in c)
                if score > 0:
                    scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


ITEMS = "item_id long, text string, rank int, score long"


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], ITEMS)


def test_search_equals_scoring_every_document(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(search(docs.repartition(3), items)) == want


def test_a_task_holds_few_blocks_of_the_stored_index(spark):
    root = Path(lexical_search.Scratch(spark, "x").root.removeprefix("file://")).parent
    before = set(root.glob("lexical-search-*"))
    docs = spark.range(0, 5, numPartitions=1).selectExpr("id AS doc_id", "concat('w', id, ' ', repeat('x', 3000000)) AS text")
    assert search(docs, items_table(spark, [(1, "w2 w4")])).count() == 2
    (new,) = set(root.glob("lexical-search-*")) - before
    (file,) = [pq.ParquetFile(f).metadata for f in (new / "index").glob("*.parquet")]
    assert file.num_rows == 5 and max(file.row_group(i).num_rows for i in range(file.num_row_groups)) <= lexical_search.GROUP_BLOCKS


def test_search_of_awkward_rows_and_in_several_passes(spark, awkward, empty, monkeypatch):
    rows = [(1, "same text HERE here"), (1, "same text HERE here"), (2, None), (3, ""), (4, "中文 line x áb x x"), (5, "w1 w2 nowhere"), (None, "of no id a b")]
    plain = [(r.doc_id, r.text) for r in awkward.collect()]
    want = ranked(plain, rows)
    assert found(search(awkward, items_table(spark, rows))) == want
    monkeypatch.setattr(lexical_search, "PASS_ITEMS", 2)
    monkeypatch.setattr(lexical_search, "UNFOLD_BYTES", 0)
    assert found(search(awkward, items_table(spark, rows))) == want
    assert search(empty, items_table(spark, rows)).count() == 0 and search(awkward, items_table(spark, [])).count() == 0


def test_ties_of_many_copies_go_to_the_least_ids(spark):
    texts = ["alpha beta gamma delta"] * 300 + [f"beta word{i}" for i in range(200)] + ["none at all"] * 100
    ids = list(range(len(texts)))
    random.Random(4).shuffle(ids)
    docs = documents(spark, texts, ids=ids).repartition(4)
    rows = [(1, "alpha"), (2, "beta beta"), (3, "word7 gamma")]
    want = ranked(list(zip(ids, texts, strict=True)), rows)
    assert found(search(docs, items_table(spark, rows))) == want


def test_bisection_brings_like_documents_together_and_stops_visits():
    rng = np.random.default_rng(5)
    topic = rng.permutation(np.arange(1024) % 16)
    lists = [np.unique(np.concatenate([rng.integers(50 * t, 50 * t + 50, 30), rng.integers(800, 900, 10)])) for t in topic]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    order = bisected(np.concatenate(lists), at, 900)
    assert sorted(order.tolist()) == list(range(1024))
    kinds = [len(set(topic[order[i : i + 64]].tolist())) for i in range(0, 1024, 64)]
    assert np.mean(kinds) < 4  # 16 without an order
    texts = [" ".join(f"t{x}" for x in some) for some in lists]
    row = lexical_search._block(0, pa.array(range(1024), pa.int64()), [lexical_search.terms_of(pa.array(texts))], 1024, sum(map(len, lists)))
    wanted = pa.array([f"t{x}".encode() for x in range(3)], pa.binary())
    block, best = Block(row | {"terms": row["terms"].cast(pa.binary())}, wanted), []
    assert block.visit(np.arange(3), np.array([5, 5, 5]), best, 20) < block.n_clusters / 2 and len(best) == 20


def test_token_files_equal_the_library(spark, sf, awkward, empty):
    lib = tokenizer(WORDS)

    def want(rows):
        out, start = [], 0
        for doc, text in rows:
            ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
            out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        return out

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    got = written_and_read(docs.repartition(5), WORDS).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want(rows)
    odd = written_and_read(awkward, WORDS).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in odd][0] == (None, 0) and len(odd) == awkward.count()
    ends = [r.start + r.n_tokens for r in odd]
    assert [r.start for r in odd][1:] == ends[:-1] and [r.doc_id for r in odd][1:] == sorted(r.doc_id for r in odd[1:])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in odd) == Counter((d, n, c) for d, _, n, c in want([(r.doc_id, r.text) for r in awkward.collect()]))
    assert written_and_read(empty, WORDS).count() == 0


def _file(docs):
    out = io.BytesIO()
    builder = Builder(out)
    for doc, ids in docs:
        builder.add(doc, np.array(ids, "<u4").tobytes())
    builder.finish()
    return out.getvalue()


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_a_file_is_read_document_by_document_and_by_any_zstandard_reader():
    rng = np.random.default_rng(8)
    docs = [(i if i else None, rng.integers(0, 49408, n).tolist()) for i, n in enumerate([3, 0, 100_000, 5, 200_000, 1, *[700] * 300])]
    data = _file(docs)
    file = File(Source(data))
    for row in (4, 0, 2, 1, 305):
        assert file.ids(row) == np.array(docs[row][1], "<u4").tobytes()
    few = File(Source(data))
    few.ids(305)
    assert few.fetched <= 2 < len(few.sums)
    assert few.rows({5, 77, 10_000}).tolist() == [5, 77] and len(few.rows(None)) == len(docs)
    plain = b"".join(np.array(ids, "<u4").tobytes() for _, ids in docs)
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    assert reader.read(len(plain) + 1) == plain
    assert File(Source(_file([]))).rows(None).tolist() == []


def test_damage_is_noticed():
    docs = [(i, list(range(i, i + 3000))) for i in range(200)]
    data = _file(docs)
    file = File(Source(data))
    for place in (int(file.packed[1]) + 40, int(file.packed[-2]) + 30):
        broken = bytearray(data)
        broken[place] ^= 0x55
        with pytest.raises((Damaged, ValueError)):
            bad = File(Source(bytes(broken)))
            for row in range(len(docs)):
                bad.ids(row)
    for cut in (0, 5, 30, len(data) // 2, len(data) - 1):
        with pytest.raises((Damaged, Exception)):
            File(Source(data[:cut]))


def test_wanted_documents_appends_and_replacement(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    write_tokens(documents(spark, [f"word {i} " * 50 for i in range(100)]).repartition(4), WORDS, folder)
    picked = read_tokens(spark, folder, [3, 50, 51, 1000]).collect()
    whole = {r.doc_id: r for r in read_tokens(spark, folder).collect()}
    assert {r.doc_id: r for r in picked} == {i: whole[i] for i in (3, 50, 51)}
    write_tokens(documents(spark, ["later"], ids=[7]), WORDS, folder, mode="append")
    again = read_tokens(spark, folder).where("doc_id = 7").orderBy("start").collect()
    assert len(again) == 2 and again[1].start == sum(r.n_tokens for r in whole.values())
    write_tokens(documents(spark, ["only"], ids=[1]), WORDS, folder)
    assert read_tokens(spark, folder).count() == 1
    left = [n for n in committed.Folder(folder).names()]
    assert len(left) == 2  # one file and one manifest
    with pytest.raises(ValueError):
        committed.Folder("/no/file/system")
    assert token_files.FRAME_BYTES % 4 == 0
