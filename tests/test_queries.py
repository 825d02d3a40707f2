"""Registered queries beside their checking SQL on the smallest data set."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

FOLDER = "/root/testdata/sf0.001"
FAMILIES = os.environ.get("QUERY_FAMILIES", "b,f,g,x1_,x2_,k3,k4,e3,d11").split(",")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def names():
    from __spark_entry__ import oracle_sql

    return [n for n in oracle_sql() if any(n.startswith(f) for f in FAMILIES)]


@pytest.fixture(scope="module")
def duck():
    from riffle.domain import BASE

    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries
    from tools_check import canon

    df = queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(canon(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def test_every_checking_sql_has_its_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
