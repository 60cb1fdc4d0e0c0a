"""Every registered query against its DuckDB oracle (the driver's gate), on
the small sf0.001 tables; queries without an oracle must run and return a
stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from pagefold.plans import registry

SF_SMALL = "/root/testdata/sf0.001"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "array<string>": "VARCHAR[]"}

# the training-data queries have tests of their own
registry.load_all()
QUERIES = dict(registry.QUERIES)
ORACLES = dict(registry.ORACLES)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "company_info" in df.columns or len(df.columns) > 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(cols) > 0
        return
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for col, dtype, *_ in cur.description:
        assert str(dtype) == SPARK_TO_DUCK.get(stypes[col], stypes[col]), (col, stypes[col], dtype)
    assert _rows(cols, rows) == _rows(dcols, cur.fetchall())
