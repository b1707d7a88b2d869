"""Every registered query of the document engine against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from parchmint import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    assert rows
    if name not in catalogue.ORACLES:
        assert all(r["error"] is None for r in df.collect())
        return
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == sorted(df.columns) and all(KINDS[t] == types[c] for c, t in df.dtypes)
    at = [names.index(c) for c in df.columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "markdown"] and df.first().markdown.startswith("# doc-")
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
