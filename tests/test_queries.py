import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k.startswith("q_")))
def test_query_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rows = sorted(repr([_plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    order = [want.columns.index(c) for c in sorted(got.columns)]
    assert sorted(want.columns) == sorted(got.columns)
    assert rows == sorted(repr([_plain(r[i]) for i in order]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
