"""Greedy matching against the sequential rule, and interval joins against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import assign
from larkspur.operators import greedy, intervals


@pytest.mark.parametrize("ties", [1, 3, 1000])
def test_greedy_is_the_sequential_rule(spark, ties):
    rng = random.Random(ties)
    rows = [(g if g else None, r, c, rng.randrange(ties) if rng.random() < 0.95 else None) for g in range(40) for r in range(rng.randrange(7)) for c in range(rng.randrange(7)) if rng.random() < 0.7]
    got = greedy.matched(spark.createDataFrame(rows, "g int, r int, c int, s int").repartition(3), ["g"], "r", "c", F.col("s")).collect()
    want = []
    for g in {r[0] for r in rows}:
        want += [(g, r, c) for r, c in assign.greedy([(s, r, c) for h, r, c, s in rows if h == g and s is not None])]
    assert sorted(((x.g, x.r, x.c) for x in got), key=str) == sorted(want, key=str)


def test_a_chain_needs_many_rounds(spark):
    """Each pair shares a row or a column with the next better one, so a round takes one pair; the result stays the rule's."""
    rows = [(1, (i + 1) // 2, i // 2, i) for i in range(12)]
    got = greedy.matched(spark.createDataFrame(rows, "g int, r int, c int, s int"), ["g"], "r", "c", F.col("s")).collect()
    assert sorted((x.r, x.c) for x in got) == sorted(assign.greedy([(s, r, c) for _, r, c, s in rows]))
    none = spark.createDataFrame([], "g int, r int, c int, s int")
    assert greedy.matched(none, ["g"], "r", "c", F.col("s")).collect() == []


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_interval_joins(spark, width):
    rng = random.Random(width)
    spans = [(rng.randrange(3), i, s := rng.randrange(-50, 50), s + rng.randrange(-2, 40)) for i in range(60)]
    points = [(rng.randrange(3), rng.randrange(-60, 100)) for _ in range(80)]
    t = spark.createDataFrame(spans, "k int, i int, s int, e int")
    p = spark.createDataFrame(points, "k int, at int")
    got = intervals.points_in(p, t, ["k"], "at", "s", "e", width)
    assert sorted((r.k, r.at, r.i) for r in got.collect()) == sorted((k, at, i) for k, at in points for h, i, s, e in spans if h == k and s <= at <= e)
    u = t.select("k", F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = intervals.overlapping(t, u, ["k"], ("s", "s2"), ("e", "e2"), width)
    want = [(k, i, j, max(a, c), min(b, d)) for k, i, a, b in spans for h, j, c, d in spans if h == k and a <= b and c <= d and a <= d and c <= b]
    assert sorted((r.k, r.i, r.j, r["from"], r["to"]) for r in met.collect()) == sorted(want)


def test_no_row_for_each_place(spark):
    import __spark_entry__ as entry

    for name in ("q_j24_window_owners", "q_w14_reused_frames", "q_u7_stored_frames", "q_t8_window_frames"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence(start_pos" not in plan


@pytest.mark.parametrize("held", [5, 60, 1 << 20])
def test_rows_and_columns_without_pairs(held):
    """The rule over matrices of scores, whole or one score at a time, against the list of all pairs; ties are many."""
    rng = np.random.default_rng(held)
    for n, m in ((0, 3), (3, 0), (1, 1), (9, 14), (14, 9), (12, 12)):
        s = np.where(rng.random((n, m)) < 0.7, rng.integers(-2, 3, (n, m)), np.iinfo(np.int64).min)
        got = greedy.take(np.arange(n)[:, None], np.arange(m)[:, None], lambda a, b: s[np.ix_(a[:, 0], b[:, 0])], held)
        want = assign.greedy([(int(s[i, j]), i, j) for i in range(n) for j in range(m) if s[i, j] != np.iinfo(np.int64).min])
        assert [x[1:] for x in got] == want and all(s[i, j] == v for v, i, j in got)


def test_matching_shuffles_rows_alone(spark):
    """What a task gets is a group's rows and columns: the plan has no join of them, and pairs are not written."""
    rows = spark.createDataFrame([(g, r, r) for g in range(5) for r in range(40)], "g long, r long, v long").repartition(3)
    cols = spark.createDataFrame([(g, c, c) for g in range(1, 7) for c in range(30)], "g long, c long, v long").repartition(4)
    out = greedy.matched_rows(rows, cols, ["g"], "r", "c", ["v"], lambda a, b: (a[:, None, 0] + b[None, :, 0]) % 7, "s")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = assign.greedy([((r + c) % 7, r, c) for r in range(40) for c in range(30)])
    assert sorted((x.g, x.r, x.c) for x in out.collect()) == sorted((g, r, c) for g in range(1, 5) for r, c in want)
