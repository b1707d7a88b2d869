"""A quality classifier over random-indexing word vectors.

Every bucket of the word hash has a sparse ternary index vector made from a seed.
A word's vector is its own index vector plus, scaled to the same length, the sum
of the index vectors of the words that stand beside it in the training texts.
Besides each word, its shape (runs of capitals, small letters and digits, and
punctuation as it is; one shape for a word that equals the one before it) is a
word of its own. A document is the mean of its
words' and its shapes' vectors; a network of two layers gives the log odds, and a
temperature fitted on rows that training has not seen makes them probabilities.
All of the fit reads one bounded sample; scoring reads whole texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import Texts, Words, bounded_batches, mix64, pieces, powers, row_sums, tidied
from parchmint.llm.labelled import labelled_sample

#: Most labelled rows that a fit reads.
SAMPLE_ROWS = 3000
BUCKETS, DIMENSIONS, HIDDEN, NONZERO = 1 << 15, 48, 32, 6
GOOD_AT = 0.7
#: Words gathered at once; bounds the temporary vectors.
_AT_ONCE = 1 << 16

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def index_vectors(seed: int = 17) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), places.shape), axis=1)
    return out / np.sqrt(NONZERO, dtype=np.float32)


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and of their shapes, and each text's place in both."""
    texts = Texts(column)
    words = Words(texts)
    shift = np.uint64(64 - 15)
    whole = words.hashes()
    own = (whole >> shift).astype(np.int32)
    if not len(own):
        return own, own, words.at
    form = _SHAPE[texts.bytes]
    keep = words.inside.copy()
    keep[1:] &= form[1:] != form[:-1]
    keep[words.starts] = True
    up, down = powers(len(form) + 1)
    place = np.cumsum(keep) - 1
    terms = np.concatenate([[np.uint64(0)], np.cumsum(np.where(keep, mix64(form.astype(np.uint64)) * up[place], np.uint64(0)), dtype=np.uint64)])
    h = (terms[words.ends] - terms[words.starts]) * down[place[words.starts]]
    h[1:][(whole[1:] == whole[:-1]) & (np.diff(words.rows()) == 0)] = 0
    return own, (mix64(h + np.uint64(99)) >> shift).astype(np.int32), words.at


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean shape vector of each text; zeros for a text without words."""
    own, shape, at = buckets(column)
    out = np.zeros((len(column), 2 * DIMENSIONS), np.float32)
    rows = np.repeat(np.arange(len(column)), np.diff(at))
    for begin in range(0, len(own), _AT_ONCE):
        end = min(begin + _AT_ONCE, len(own))
        cuts = np.clip(at, begin, end) - begin
        touched = slice(rows[begin], rows[end - 1] + 1)
        local = cuts[touched.start : touched.stop + 1]
        out[touched, :DIMENSIONS] += row_sums(vectors[own[begin:end]], local)
        out[touched, DIMENSIONS:] += row_sums(vectors[shape[begin:end]], local)
    return out / np.maximum(np.diff(at), 1)[:, None].astype(np.float32)


def word_vectors(columns: list[pa.Array], index: np.ndarray, reach: int = 2) -> np.ndarray:
    """Index vectors plus normalised sums of neighbours' index vectors in the given texts."""
    context = np.zeros((BUCKETS, DIMENSIONS))
    for column in columns:
        own, shape, at = buckets(column)
        rows = np.repeat(np.arange(len(column)), np.diff(at))
        for sequence in (own, shape):
            for step in range(1, reach + 1):
                same = rows[step:] == rows[:-step]
                left, right = sequence[:-step][same], sequence[step:][same]
                pairs, times = np.unique(np.concatenate([left.astype(np.int64) * BUCKETS + right, right.astype(np.int64) * BUCKETS + left]), return_counts=True)
                word, beside = pairs // BUCKETS, pairs % BUCKETS
                for d in range(DIMENSIONS):
                    context[:, d] += np.bincount(word, times * index[beside, d], BUCKETS)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    return (index + np.where(size > 0, context / np.maximum(size, 1e-9), 0)).astype(np.float32)


def forward(x: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"], 0)
    return hidden, hidden @ net["w2"] + net["b2"]


def fit(sample: pa.Table, rounds: int = 300, seed: int = 5) -> dict | None:
    """Word vectors, network and temperature; None where the sample lacks one of the labels."""
    y = np.array(sample.column("label").to_pylist(), np.float64)
    if len(np.unique(y)) < 2:
        return None
    columns = [sample.slice(k, 300).column("text").combine_chunks() for k in range(0, len(y), 300)]
    vectors = word_vectors(columns, index_vectors())
    x = np.concatenate([pooled(c, vectors) for c in columns]).astype(np.float64)
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    net = {"mean": x[~held].mean(0), "scale": x[~held].std(0) + 1e-6}
    net |= {"w1": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), "b2": np.zeros(1)}
    names = ("w1", "b1", "w2", "b2")
    m, v = {k: np.zeros_like(net[k]) for k in names}, {k: np.zeros_like(net[k]) for k in names}
    rows, t = np.flatnonzero(~held), 0
    for _ in range(rounds // 5):
        rng.shuffle(rows)
        for part in np.array_split(rows, 5):
            t += 1
            hidden, z = forward(x[part], net)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / max(len(part), 1)
            back = np.outer(g, net["w2"]) * (hidden > 0)
            grads = {"w1": ((x[part] - net["mean"]) / net["scale"]).T @ back + 1e-4 * net["w1"], "b1": back.sum(0), "w2": hidden.T @ g + 1e-4 * net["w2"], "b2": g.sum(keepdims=True)}
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                net[k] = net[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    use = held if held.any() else ~held
    z = forward(x[use], net)[1]
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [np.mean(np.logaddexp(0, np.where(y[use] == 1, -z, z) / temperature)) for temperature in grid]
    return net | {"vectors": vectors, "temperature": float(grid[int(np.argmin(loss))])}


def scores(column: pa.Array, model: dict) -> np.ndarray:
    z = forward(pooled(column, model["vectors"]), model)[1] / model["temperature"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(column: pa.Array) -> np.ndarray:
    """Rows that no fit reads: crc32 of the id as text leaves 2 modulo 4."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in column.to_pylist()], bool)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each row of ``docs``.

    Labels are read only from rows that are not held out. Without labels of both
    kinds every score is 0.5. A null or blank text has the score of the zero vector.
    Repeated rows and null ids (never held out) give a row each; an empty table gives none.
    """
    open_ = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 4 != 2
    model = fit(labelled_sample(docs, labels, sample_rows, open_))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied("quality_model")
    def score(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                p = scores(batch.column("text"), shared.value) if shared.value else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held_out(batch.column("id"))), pa.array(p.astype(np.float64)), pa.array((p >= GOOD_AT).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(score, "id long, held_out boolean, score double, predicted int")
