"""Stored preferences: validation, and the options that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.options import LANGUAGES, ConvertOptions

FLAGS = ("ocr", "extended", "normalize", "hyphens")


def valid_language(value: Column) -> Column:
    """The language if it is offered, else null."""
    return F.when(value.isin(*LANGUAGES), value)


def valid_flag(value: Column) -> Column:
    """True or false for exactly these words, else null."""
    return F.when(value.isin("true", "false"), value == "true")


def load_preferences(stored: DataFrame, session: str = "session") -> DataFrame:
    """One row of options for each session of stored (session, key, value); what is missing or invalid has its default."""
    defaults = ConvertOptions()

    def last(key: str, valid: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("key") == key, valid)), F.lit(getattr(defaults, key))).alias(key)

    value = F.col("value")
    return stored.groupBy(session).agg(last("lang", valid_language(value)), *[last(k, valid_flag(value)) for k in FLAGS])


def stored_preferences(options: DataFrame, session: str = "session") -> DataFrame:
    """The same options as rows (session, key, value), as they are stored."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("lang", *FLAGS)])
    return options.select(session, F.explode(entries).alias("e")).select(session, "e.*")
