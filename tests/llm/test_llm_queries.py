"""Every registered query of the subpackage over the smallest tables, against its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [k for k in entry.queries() if not k.startswith("q_")]


def _plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF)
    rows = sorted(repr([_plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(sql)
    order = [want.columns.index(c) for c in sorted(got.columns)]
    assert sorted(want.columns) == sorted(got.columns) and rows == sorted(repr([_plain(r[i]) for i in order]) for r in want.fetchall())


def test_all_are_registered():
    assert sorted(n.split("_")[0] for n in NAMES) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
