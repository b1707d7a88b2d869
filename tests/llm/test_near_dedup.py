from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from parchmint.llm import near_dedup
from parchmint.llm.arrowtext import Texts, Words
from parchmint.llm.components import connected_components
from parchmint.llm.near_dedup import least_matches, near_duplicates, shingles
from parchmint.llm.scratch import Scratch
from tests.llm.conftest import documents

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sets(texts, k):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(texts, k, percent=80):
    found, parent = sets(texts, k), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(found):
        for j in range(i):
            common = len(a & found[j])
            if common and 100 * common >= percent * len(a | found[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(found[i]), root(i)) for i in range(len(texts))}


def test_words_and_shingles_of_a_sliced_batch():
    texts = ["", "A b\tc", None, " x ", "é\xa0y z"]
    column = pa.array(["skip me", *texts])[1:]
    assert Words(Texts(column)).counts.tolist() == [0, 3, 0, 1, 2]
    h, at = shingles(column, 2)
    assert np.diff(at).tolist() == [0, 2, 0, 1, 1]


def test_posterior_bound_is_the_binomial_tail():
    least = least_matches(0.8, 1e-7)
    assert least == sorted(least) and 0 <= least[0] < 10 and 50 < least[-1] < 70


def test_components_equal_brute_force(spark, copies):
    for k in (2, 5):
        got = {r.id: (r.n_shingles, r.component) for r in near_duplicates(documents(spark, copies), shingle=k).collect()}
        assert got == brute(copies, k)


def test_blocks_of_large_buckets_equal_brute_force(spark, monkeypatch):
    """Groups of some hundred near copies, so that buckets take many blocks, with members just below the threshold."""
    rng, texts = random.Random(3), []
    for size, cuts in ((700, (0, 4, 9, 14)), (300, (10, 11, 12, 13)), (40, (30,))):
        base = [f"b{size}x{i}" for i in range(100)]
        for _ in range(size):
            other = list(base)
            for place in rng.sample(range(1, 99, 2), rng.choice(cuts)):
                other[place] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    rng.shuffle(texts)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 1 << 14)
    got = {r.id: (r.n_shingles, r.component) for r in near_duplicates(documents(spark, texts), shingle=2).collect()}
    want = brute(texts, 2)
    assert got == want and len({c for _, c in want.values()}) > 50


def test_a_chain_of_near_copies_is_one_component(spark):
    base = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(12):
        base = base.copy()
        base[5 * i % 60] = f"new{i}"
        texts.append(" ".join(base))
    got = {r.id: (r.n_shingles, r.component) for r in near_duplicates(documents(spark, texts), shingle=2).collect()}
    assert got == brute(texts, 2)


def test_awkward_rows(spark, awkward, empty):
    rows = near_duplicates(awkward, shingle=2).collect()
    assert len(rows) == awkward.count()
    by = {r.id: r for r in rows}
    assert by[None].component is None and by[0].n_shingles == 0 and by[0].component == 0
    assert by[6].component == 5 and by[2].component == 2 and by[3].n_shingles == 1
    assert near_duplicates(empty).count() == 0


def test_rows_that_share_an_id_are_one_node(spark):
    texts = ["a b c d e f g h", "q r s t u v w x", "a b c d e f g h", "q r s t u v w x"]
    rows = near_duplicates(documents(spark, texts, ids=[7, 7, 8, 9]), shingle=2).collect()
    assert {(r.id, r.component) for r in rows} == {(7, 7), (8, 7), (9, 7)}


def test_connected_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 202), (202, 200), (None, 3)]
    got = {r.node: r.label for r in connected_components(Scratch(spark, "t"), "cc", spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200, 202: 200}
