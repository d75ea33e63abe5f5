"""Ownership frequency of secrets: repositories and owners that differ, odd rows, the SQL text."""

import random

from pyspark.sql import functions as F

from larkspur.llm import secrets

SCHEMA = "doc_id long, text string, source string, repo string, owner string, row long, start int, hash string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, r, o, 1, 2, "x") for i, t, s, r, o in rows], SCHEMA)


def _token(rng):
    return "Z" + "".join(rng.choice("ghijklXYZ0123456789") for _ in range(30)) + "7"


def test_repositories_and_owners_decide_apart(spark):
    rng = random.Random(1)
    alone, wide, shared = (_token(rng) for _ in range(3))
    rows = [(1, f"see {alone}", None, "r1", "a"), (2, f"{alone} again", None, "r2", "a")]
    rows += [(10 + i, f"{i} {wide}", None, f"r{i}", "a") for i in range(4)]
    rows += [(20 + i, f"{i} {shared}", None, "same", f"o{i}") for i in range(2)]
    base = "password = hunter22"
    rows += [(30 + i, base, None, f"r{i}", "a") for i in range(5)] + [(40, "secret: abcdef", None, "q", "b")]
    p = secrets.Params(max_repos=3, max_owners=1, wide_owners=3, wide_repos=5)
    got = {r.doc_id: ([s.kind for s in r.spans], r.n_example, r.n_owned) for r in secrets.scan(_docs(spark, rows), "repo", "owner", p).collect()}
    assert got[1] == got[2] == (["live"], 0, 0)
    assert {i: got[i] for i in (10, 11, 12, 13, 20, 21)} == dict.fromkeys((10, 11, 12, 13, 20, 21), ([], 0, 0))
    assert all(got[i] == (["assign"], 1, 0) for i in range(30, 35)) and got[40] == (["assign"], 0, 1)


def test_candidates_over_base_spans_are_left_out(spark):
    t = "Q" + "g1" * 15
    docs = _docs(spark, [(1, f"token={t} and {t[::-1]}", "a", None, None), (2, f"x token={t}", "a", None, None), (3, t + "=" + t, "a", None, None), (None, None, None, None, None)])
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(docs).collect()}
    n = len(t)
    assert got[1] == [("assign", 0, n + 6), ("live", n + 11, 2 * n + 11)] and got[2] == [("assign", 2, n + 8)] and got[None] == []
    assert got[3] == [("live", 0, n), ("live", n + 1, 2 * n + 1)]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"token={i:06d}" for i in range(20_000))
    r = secrets.scan(_docs(spark, [(1, text, "a", None, None)])).select(F.size("base"), F.col("base")[19_999]["end"]).collect()
    assert r == [(20_000, len(text))]


def test_same_as_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(4)
    pool = [_token(rng) for _ in range(6)]
    kinds = [lambda: f"Api_Key = '{rng.choice(pool)}'", lambda: rng.choice(pool), lambda: "AKIA" + "A1" * 9, lambda: "0a" * 13, lambda: "pass\u017fwd=abcdefgh", lambda: "é\U0001f600", lambda: "token: abc"]
    rows = [(None if i % 9 == 0 else i % 60, None if i % 13 == 0 else " ".join(rng.choice(kinds)() for _ in range(rng.randint(0, 6))), rng.choice([None, "a", "b", "c"])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in secrets.op2_secret_scan(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(secrets.OP2_SQL).fetchall()
    assert got == sorted(map(str, want))
