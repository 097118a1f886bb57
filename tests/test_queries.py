"""Every registered query of the library proper against its SQL in DuckDB."""

import math

import duckdb
import pytest

from textloom.plans import last_queries, more_queries  # noqa: F401
from textloom.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    if hasattr(v, "quantize"):
        return round(float(v), 7)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
