"""Batches between the JVM and Python: their size, and their values as Python's."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a batch between the JVM and Python, in place of Spark's much larger default.
BATCH_BYTES = 8 << 20


def bounded_batches(spark) -> None:
    """Let the session's Arrow batches hold ``BATCH_BYTES`` at most; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = (spark.conf.get(name, None) or "0").lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(held[-1:], 1)
    if not 0 < int(held.rstrip("kmg") or 0) * scale <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def values(column: pa.Array) -> list:
    """The values of a flat column (None for null), as ``to_pylist`` gives them; numbers and strings are made without an Arrow object each."""
    kind = column.type
    numbers = (pa.types.is_integer(kind) or pa.types.is_floating(kind)) and not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if numbers or pa.types.is_string(kind) else column.to_pylist()


def fields(column: pa.Array, *names: str) -> list[tuple]:
    """Tuples of the flat fields of a column of structs; those of a null struct are null."""
    return list(zip(*(values(pc.struct_field(column, [name])) for name in names), strict=True))


def lists(column: pa.Array, made: Callable[[pa.Array], list]) -> list[list | None]:
    """The lists of a column (None for null), cut from what ``made`` gives for the elements of all rows at once."""
    flat, at, out = made(column.flatten()), 0, []
    for size in pc.list_value_length(column).to_pylist():
        out.append(None if size is None else flat[at : at + size])
        at += size or 0
    return out
