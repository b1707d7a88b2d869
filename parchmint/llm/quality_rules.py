"""Quality rules: exact counts of a text, and a hashed n-gram logistic regression.

The regression has hashed word (1 and 2) and character (3 and 4) n-grams, each
kind as shares of its own total. It is fitted on the driver on a bounded sample
of labelled rows, and its probabilities are calibrated on a part of that sample
which the fit has not seen. Scoring reads Arrow batches; a weight is looked up
for every n-gram of the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import BLANKS, Texts, Words, as_texts, bounded_batches, mix64, ngram_hashes, pieces, tidied
from parchmint.llm.labelled import labelled_sample

#: Most labelled rows that a fit reads.
SAMPLE_ROWS = 2500
#: Rows whose n-grams are counted at once, and rows of a stored part of the sample; a round of the fit reads part after part.
COUNTED_ROWS, PART_ROWS = 100, 500
BUCKETS = 1 << 18
#: Fixed thresholds.
LEAST_WORDS, MOST_REPEATED_PERCENT, KEEP_AT = 20, 30, 0.5
WINDOW = 8
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Per text: words, code points in words, symbols, and words in repeated windows of eight."""
    texts = Texts(column)
    words = Words(texts)
    starts = (texts.bytes & 0xC0) != 0x80
    runs, at = ngram_hashes(words.hashes(), words.at, WINDOW)
    sizes = np.diff(at)
    sizes[words.counts < WINDOW] = 0
    inside = np.repeat(words.counts >= WINDOW, np.diff(at))
    own = mix64(runs ^ mix64(np.repeat(np.arange(texts.n, dtype=np.uint64), np.diff(at))))
    first = np.arange(len(runs)) - np.repeat(at[:-1], np.diff(at)) + np.repeat(words.at[:-1], np.diff(at))
    own, first = own[inside], first[inside]
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(own), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": texts.sums(words.inside & starts),
        "n_symbols": texts.sums(_SYMBOLS[texts.bytes]),
        "n_repeat_words": covered[words.at[1:]] - covered[words.at[:-1]],
    }


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def ngrams(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram, the buckets of all in the batch and each text's place in them."""
    words = Words(Texts(column))
    single = words.hashes()
    shift = np.uint64(64 - 18)
    found = [((single >> shift).astype(np.int32), words.at)]
    two, at = ngram_hashes(single, words.at, 2)
    found.append(((mix64(two + np.uint64(1)) >> shift).astype(np.int32), at))
    strings = column.to_pylist()
    points = np.frombuffer("".join([s or "" for s in strings]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([0, *(len(s or "") for s in strings)])
    for size in (3, 4):
        runs = max(len(points) - size + 1, 0)
        h = np.zeros(runs, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + runs]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)
        bucket = (h >> shift).astype(np.int32)
        own = np.maximum(np.diff(ends) - size + 1, 0)  # n-grams across two texts are left out
        at = np.concatenate([[0], np.cumsum(own)])
        index = np.arange(at[-1]) + np.repeat(ends[:-1] - at[:-1], own)
        found.append((bucket[index], at))
    return found


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(sample: pa.Table, rounds: int = 60, decay: float = 1e-4) -> dict | None:
    """Weights, intercept and calibration; None where the sample lacks one of the labels."""
    y = np.array(sample.column("label").to_pylist(), np.float64)
    if len(np.unique(y)) < 2:
        return None
    held = np.arange(len(y)) % 3 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    parts: list[tuple] = []  # of rows that the fit sees: row, column, share
    unseen: list[tuple] = []
    for first in range(0, len(y), PART_ROWS):
        found = {False: ([], [], []), True: ([], [], [])}
        for start in range(first, min(first + PART_ROWS, len(y)), COUNTED_ROWS):
            part = sample.slice(start, min(COUNTED_ROWS, first + PART_ROWS - start))
            for kind, (bucket, at) in enumerate(ngrams(part.column("text").combine_chunks())):
                row = np.repeat(np.arange(len(part)), np.diff(at))
                key, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                r = (key // BUCKETS).astype(np.int32)
                share = (count / np.maximum(np.diff(at), 1)[r]).astype(np.float32)
                for out, ours in ((found[h], held[r + start] == h) for h in (False, True)):
                    out[0].append(r[ours] + np.int32(start))
                    out[1].append((key[ours] % BUCKETS + kind * BUCKETS).astype(np.int32))
                    out[2].append(share[ours])
        parts.append(tuple(map(np.concatenate, found[False])))
        unseen.append(tuple(map(np.concatenate, found[True])))
    size = 4 * BUCKETS
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0

    def sums(of: list[tuple], w: np.ndarray) -> np.ndarray:
        z = np.zeros(len(y))
        for row, col, val in of:
            z += np.bincount(row, val * w[col], len(y))
        return z

    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) * ~held
    for t in range(1, rounds + 1):
        z = sums(parts, w) + b
        g = (sigmoid(z) - y) * weight / weight.sum()
        grad = decay * w
        for row, col, val in parts:
            grad += np.bincount(col, val * g[row], size)
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        v += 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        w -= 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9) * (v > 0)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    z = sums(parts, w) + sums(unseen, w) + b
    use = held if held.any() else np.ones(len(y), bool)
    slope, shift = calibrate(z[use], y[use])
    return {"weights": w.astype(np.float32), "intercept": float(b), "slope": slope, "shift": shift}


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the log odds that make held-back labels likeliest, by Newton steps with a weak prior."""
    scale = max(float(np.abs(z).mean()), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], axis=1)
    target = (y * y.sum() + y) / (y.sum() + 2) + (1 - y) / ((1 - y).sum() + 2)
    p = np.array([1.0, 0.0])
    for _ in range(rounds):
        q = sigmoid(x @ p)
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (q - target) + 1e-3 * (p - [1.0, 0.0]))
        p = p - np.clip(step, -2, 2)
    return float(p[0] / scale), float(p[1])


def probabilities(column: pa.Array, model: dict) -> np.ndarray:
    """The calibrated probability of label 1 of each text."""
    z = np.full(len(column), model["intercept"])
    for kind, (bucket, at) in enumerate(ngrams(column)):
        w = model["weights"][kind * BUCKETS : (kind + 1) * BUCKETS]
        total = np.concatenate([[0.0], np.cumsum(w[bucket], dtype=np.float64)])
        z += (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)
    return sigmoid(model["slope"] * z + model["shift"])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"


def quality_rules(docs: DataFrame, training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, counts, probability, base_failed and kept (and the ``carry`` columns).

    A null text has no words and fails the base rules, as do texts under 20 words.
    Without labels of both kinds every probability is 1. Repeated rows and null ids
    give a row each; an empty table gives none. A carried column with the name of a
    result stands in its place, but for kept.
    """
    model = fit(labelled_sample(training, labels, sample_rows))
    carry = carry or []
    beside = [c for c in carry if c not in (id_col, text_col)]
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c_{c}") for c in beside])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept_names = [f"c_{c}" for c in beside] + ["text"] * (text_col in carry)

    @tidied("quality_rules")
    def score(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                column = batch.column("text")
                found = counts(column)
                lines = np.array([repeated_lines(t) for t in as_texts(batch, "text")], np.int64)
                p = probabilities(column, shared.value) if shared.value else np.ones(len(column))
                values = [found["n_words"], found["word_chars"], found["n_symbols"], lines, found["n_repeat_words"], p]
                names = ["id", *kept_names, *(c.split(" ")[0] for c in RESULT.split(", "))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in kept_names), *map(pa.array, values)], names=names)

    kinds = dict(chosen.dtypes)
    schema = ", ".join([f"id {kinds['id']}", *(f"`{c}` {kinds[c]}" for c in kept_names), RESULT])
    bounded_batches(docs.sparkSession)
    scored = chosen.mapInArrow(score, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP_AT))
    named = [F.col(f"c_{c}").alias(c) for c in beside] + [F.col("text").alias(text_col)] * (text_col in carry)
    results = [*(c.split(" ")[0] for c in RESULT.split(", ")), "base_failed", "kept"]
    return scored.select("id", *named, *[c for c in results if c not in carry])
