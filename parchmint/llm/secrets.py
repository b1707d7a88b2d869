"""Secret scanning with SQL functions only.

Three fixed patterns give the base spans. Further candidates are long runs of
token characters; a window slides over each, and the Shannon entropy of every
window follows from the counts of the characters that enter and leave it. The counts
are packed into a few longs, so a step adds one and takes one away. A run is reported where some
window reaches the threshold of its character class, unless the allow-list knows it or a
base span holds all of it. Offsets are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short has no longer run inside it, so these keep only what passes.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 6
WINDOW = 20
#: Character classes, the first that a run belongs to counts, and the bits a character that some window of it must reach.
#: Digits alone reach log2(10) = 3.32 at most and are numbers, so none do. About 1 in 100 random strings of 20 characters of the
#: classes with digits stays below (one-case hexadecimal digits: 9). Words run together come close to random letters, so
#: letters alone must be nearly all different.
CLASSES = (
    ("digits", r"^[0-9+/_=-]+$", 9.0),
    ("hexadecimal", r"^[0-9A-Fa-f]+$", 3.1),
    ("letters of one case", r"^(?:[a-z+/_=-]+|[A-Z+/_=-]+)$", 4.0),
    ("letters", r"^[A-Za-z+/_=-]+$", 3.9),
    ("letters of one case and digits", r"^(?:[0-9a-z+/_=-]+|[0-9A-Z+/_=-]+)$", 3.4),
    ("any", r"", 3.6),
)
#: Runs that look random and are not: UUIDs, alphabets, placeholders, dates and version numbers, page addresses.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)abcdefghij|0123456789|1234567890|qwertyuiop",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(key|token)|redacted|x{6,}",
    r"^[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}$",
    r"^(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/](?:[A-Za-z]+|[0-9]{1,4}))+/?$",
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of 5 bits that a long holds.
_PACKED = 12
_SPAN = "struct<start:int,kind:int,stop:int,body:string>"


def _located(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """Spans of a pattern's matches: the running length of the gaps and matches before each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    parts = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("g"), value.alias("v"))
    parts = F.filter(parts, lambda p: p["m"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        stop = start + F.length(p["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), p["m"].alias("body"))
        keep = F.length(p["v"]) >= LEAST_VALUE if value_group else F.lit(True)
        return F.struct(stop.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast(f"array<{_SPAN}>")
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def window_entropy(body: Column) -> Column:
    """The most bits a character of any window of ``WINDOW`` characters of a candidate.

    For a window with counts c the entropy is log2(n) - sum(c log2 c) / n; a step adds
    the difference that the entering character makes and takes that of the leaving one.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    places = F.transform(F.split(body, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
    words = range(-(-len(_ALPHABET) // _PACKED))

    def held(acc: Column, place: Column) -> Column:
        """How often a character is in the window."""
        word = F.element_at(acc["counts"], F.floor(place / _PACKED).cast("int") + 1)
        return F.call_function("shiftright", word, _shift(place)).bitwiseAND(31).cast("int")

    def step(acc: Column, i: Column) -> Column:
        enter = F.element_at(places, i)
        leave = F.when(i > WINDOW, F.element_at(places, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(-1))
        before = held(acc, enter)
        gain = F.element_at(weight, before + 2) - F.element_at(weight, before + 1)
        left = held(acc, F.greatest(leave, F.lit(0))) + F.when(leave == enter, 1).otherwise(0)
        loss = F.when(leave >= 0, F.element_at(weight, left + 1) - F.element_at(weight, F.greatest(left, F.lit(1)))).otherwise(F.lit(0.0))

        def one(place: Column, k: int) -> Column:
            return F.when(F.floor(place / _PACKED) == k, F.call_function("shiftleft", F.lit(1).cast("long"), _shift(place))).otherwise(F.lit(0).cast("long"))

        after = F.array(*[F.element_at(acc["counts"], k + 1) + one(enter, k) - one(leave, k) for k in words])
        total = acc["total"] + gain - loss
        bits = F.when(i >= WINDOW, F.lit(math.log2(WINDOW)) - total / F.lit(float(WINDOW))).otherwise(F.lit(0.0))
        return F.struct(after.alias("counts"), total.alias("total"), F.greatest(acc["best"], bits).alias("best"))

    start = F.struct(F.array(*[F.lit(0).cast("long") for _ in words]).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.length(body)), start, step, lambda acc: acc["best"])


def _shift(place: Column) -> Column:
    return (F.pmod(F.greatest(place, F.lit(0)), F.lit(_PACKED)) * 5).cast("int")


def _suspicious(body: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | body.rlike(pattern)
    least = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(body.rlike(pattern), bits).otherwise(least)
    return ~allowed & (window_entropy(body) >= least)


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns n_assign, n_access, n_hex, base_sha256, spans and secret_spans.

    secret_spans is an array of (start, kind, stop), sorted by start, then kind; spans writes it
    as kind:start:stop joined by commas, and base_sha256 is the SHA-256 of the base
    spans so written. Null and empty texts have no spans. Rows are neither
    dropped nor merged; columns of these names in ``docs`` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [_located(text, ASSIGN, 0, 2), _located(text, ACCESS, 1), _located(text, HEX, 2)]
    found = docs.withColumns({"_assign": kinds[0], "_access": kinds[1], "_hex": kinds[2], "_more": _located(text, CANDIDATE, 3)})
    found = found.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    free = F.filter("_more", lambda m: ~F.exists("_base", lambda b: (b["start"] <= m["start"]) & (m["stop"] <= b["stop"])) & _suspicious(m["body"]))
    found = found.withColumn("_more", F.when(F.size("_more") > 0, free).otherwise(F.col("_more")))
    every = F.array_sort(F.concat("_base", "_more"))
    bare = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    found = found.withColumns(
        {
            "n_assign": F.size("_assign").cast("long"), "n_access": F.size("_access").cast("long"), "n_hex": F.size("_hex").cast("long"),
            "base_sha256": F.sha2(_written(F.col("_base")), 256), "spans": _written(every), "secret_spans": bare,
        }
    )
    return found.drop("_assign", "_access", "_hex", "_more", "_base")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by ``mask``; null stays null."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(apart, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
