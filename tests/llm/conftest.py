from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, kept boolean, label string"


def documents(spark, texts, sources=None, ids=None):
    """A documents table with further columns whose names clash with those of operators."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or [f"src{i % 7}" for i in range(len(texts))]
    rows = [(i, t, "en", s, len(t or ""), "x", 1, True, "y") for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


#: Null, empty, blank, short, repeated and very long texts, and rows that repeat whole.
AWKWARD = [None, "", " \n\t ", "one", "one two", "same text here for all of us", "same text here for all of us", "é 中文 😀 \x00 x", "a b " * 20000, "line\nline\n\nline", "x" * 50000]


@pytest.fixture(scope="session")
def awkward(spark):
    ids = [*range(len(AWKWARD)), None, 5]
    return documents(spark, [*AWKWARD, "text of no id", AWKWARD[5]], ids=ids)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def copies():
    """Texts with exact copies, near copies by degrees, and fresh ones."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            other = list(base)
            for _ in range(rng.randrange(max(2, len(base) // 12))):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other).capitalize())
    return texts
