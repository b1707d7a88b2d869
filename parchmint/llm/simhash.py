"""SimHash fingerprints of 128 bits, their likeness, and search within a Hamming radius.

Each term of a text (a pair of adjacent words, A-Z lower-cased; a lone word by
itself) votes with its number of occurrences: for every bit of its hash, +1 or
-1. The fingerprint has the bits with positive sums. The votes of a batch are
counted as histograms of the hashes' bytes, times the bits of the 256 bytes.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import Texts, Words, mix64, ngram_hashes
from parchmint.llm.neighbours import with_successor

BITS = 128
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)


def fingerprints(texts: list[str]) -> list[bytes]:
    """The fingerprint of each text; a text without words has no set bits."""
    words = Words(Texts(pa.array(texts, pa.large_string()), lower=True))
    one, at = ngram_hashes(words.hashes(), words.at, 2)
    hashes = np.stack([one, mix64(one ^ np.uint64(0x5851F42D4C957F2D))], axis=1).view(np.uint8).reshape(-1, BITS // 8)
    out = []
    counts = np.diff(at)
    for begin in range(0, len(texts), 256):
        end = min(begin + 256, len(texts))
        rows = np.repeat(np.arange(end - begin), counts[begin:end])
        part = hashes[at[begin] : at[end]]
        votes = np.empty((end - begin, BITS), np.float32)
        for k in range(BITS // 8):
            histogram = np.bincount(rows * 256 + part[:, k], minlength=(end - begin) * 256).reshape(-1, 256)
            votes[:, 8 * k : 8 * k + 8] = histogram.astype(np.float32) @ _SIGNS
        out += [bits.tobytes() for bits in np.packbits(votes > 0, axis=1)]
    return out


def likeness(one: bytes, two: bytes) -> float:
    """Estimated cosine of the term vectors, 0 to 1: 1 for equal fingerprints, 0 for half of the bits apart or more."""
    apart = (int.from_bytes(one, "big") ^ int.from_bytes(two, "big")).bit_count()
    return max(0.0, float(np.cos(np.pi * apart / BITS))) if apart else 1.0


RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[dict], following: list[dict | None]) -> list[dict]:
    own = [r["text"] or "" for r in rows]
    nexts = [(f["text"] or "") if f else "" for f in following]
    halves = [len(t) // 2 for t in own]
    edited = [t[: len(t) - h] + n[:h] for t, n, h in zip(own, nexts, halves, strict=True)]
    prints = fingerprints([*own, *nexts[-1:]])
    changed = fingerprints(edited)
    return [
        {
            "id": r["id"], "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(),
            "fingerprint": a.hex(), "edited_fingerprint": b.hex(), "near_edited": likeness(a, b), "near_next": likeness(a, c),
        }
        for r, t, e, a, b, c in zip(rows, own, edited, prints[:-1], changed, prints[1:], strict=True)
    ]


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and two likenesses.

    The edited text has the last floor(n/2) code points replaced by the first as
    many (or all) of the next document, by ascending id, the first one's after the
    last. Equal ids are ordered by their texts' hashes, null ids come first. A null
    text counts as empty; a table with one row is its own next. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    return with_successor(rows, ["id", "tie"], "text", _compare, RESULT, wrap=True)


def within_radius(prints: DataFrame, radius: int = 3, id_col: str = "id", print_col: str = "fingerprint", queries: DataFrame | None = None, spare: int = 2) -> DataFrame:
    """Rows (a, b, distance): ids of fingerprints (hex) at most ``radius`` bits apart.

    The bits are cut into radius + ``spare`` blocks. Two fingerprints within the radius agree
    on at least ``spare`` blocks, so a table for each choice of ``spare`` blocks, keyed
    by them, finds every pair; a pair is kept from the first choice that holds it.
    Equal fingerprints are one row, their least id, and are returned as links to
    that id, so copies never yield all their pairs. With ``queries``, only pairs whose a
    is a query are returned. Null fingerprints link with nothing.
    """
    blocks = radius + spare
    cut = [round(i * BITS / blocks) for i in range(blocks + 1)]
    known = prints.where(F.col(print_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(print_col).alias("print"))

    def halves(name: str, col) -> list:
        return [F.conv(F.substring(col, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"{name}{k}") for k in (0, 1)]

    def block(name: str, i: int):
        """Bits cut[i]:cut[i + 1] as a masked pair of longs."""
        out = []
        for k in (0, 1):
            lo, hi = max(cut[i], 64 * k), min(cut[i + 1], 64 * k + 64)
            mask = ((1 << (64 * k + 64 - lo)) - 1) ^ ((1 << (64 * k + 64 - hi)) - 1) if hi > lo else 0
            out.append(F.col(f"{name}{k}").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)))
        return out

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(c).alias("t"), F.xxhash64(*[x for i in choice for x in block(name, i)]).alias("k")) for c, choice in enumerate(itertools.combinations(range(blocks), spare))]
        return df.withColumn("key", F.explode(F.array(*keys))).select("*", "key.t", "key.k").drop("key")

    groups = known.groupBy("print").agg(F.min("id").alias("first"))
    sides = groups.select("print", "first", *halves("p", F.col("print")))
    asked = groups if queries is None else groups.join(known.join(queries.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi").select("print").distinct(), "print", "left_semi")
    left = tables(asked.select(F.col("first").alias("a"), *halves("q", F.col("print"))), "q")
    right = tables(sides.select(F.col("first").alias("b"), "p0", "p1"), "p")
    distance = F.bit_count(F.col("q0").bitwiseXOR(F.col("p0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("p1")))
    met = left.join(right, ["t", "k"]).where("a <> b" if queries is not None else "a < b").withColumn("distance", distance.cast("int")).where(F.col("distance") <= radius)
    copies = known.join(groups, "print").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    return met.select("a", "b", "distance").distinct().unionByName(copies)
