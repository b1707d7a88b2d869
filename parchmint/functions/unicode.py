"""Unicode normalisation, which Spark has no function for: one Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parchmint.functions.batches import bounded_batches


@F.pandas_udf(StringType())
def composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; ASCII strings pass unchanged, null stays null. The session's batches are bounded in bytes."""
    bounded_batches(SparkSession.active())
    return composed(text)
