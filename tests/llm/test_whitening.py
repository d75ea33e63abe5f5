"""Whitening against a dense eigensolver on the whole covariance, and LOBPCG on matrices it has to iterate for."""

import math

import numpy as np
import pytest

from larkspur.llm.whitening import Params, lobpcg, whiten

SCHEMA = "vec_id long, embedding array<float>, component int"


def _dense(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, dev, e[::-1], u[:, ::-1], y


def _held(got, ids, vectors, k):
    n, dev, e, u, y = _dense(vectors)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, rows in by.items():
        rows = sorted(rows, key=lambda r: ids.index(r.vec_id))
        assert [r.vec_id for r in rows] == ids and {r.n for r in rows} == {n} and [r.deviation for r in rows] == dev
        w = y @ u[:, c - 1] / math.sqrt(e[c - 1])
        w *= np.sign(w @ [r.whitened for r in rows])
        assert np.abs(w - [r.whitened for r in rows]).max() < 1e-8
        assert abs(rows[0].explained - e[c - 1] / e.sum()) < 1e-12 and len({r.identity_error for r in rows}) == 1
        assert rows[0].identity_error < 1e-10


def test_table_against_dense_solver(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, list(r.embedding)) for r in table.collect())
    _held(whiten(table).collect(), [i for i, _ in rows], [v for _, v in rows], 8)


def test_rows_that_are_left_out_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.standard_normal(5).astype(np.float32)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 0.0, 0.0, 0.0]), (104, [1.0, float("-inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1) for r in good + bad], SCHEMA).repartition(3)
    _held(whiten(table).collect(), [i for i, _ in good], [v for _, v in good], 5)
    twice = spark.createDataFrame([(None if i % 2 else i, v, 0) for i, v in good + good], SCHEMA)
    assert whiten(twice).count() == 80 * 5


def test_few_rows(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).collect() == []  # no variance, no component
    assert whiten(spark.createDataFrame([(i, [3.0, 4.0], 0) for i in range(4)], SCHEMA)).collect() == []
    two = whiten(spark.createDataFrame([(1, [0.0, 0.0, 1.0], 0), (2, [1.0, 0.0, 1.0], 0)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 12), r.explained) for r in two) == [(1, 1, 2, 1024**2, -1.0, 1.0), (2, 1, 2, 1024**2, 1.0, 1.0)]


def test_deviation_beyond_64_bits_is_null(spark):
    rows = whiten(spark.createDataFrame([(i, [float(i) * 1e6, -float(i) * 2e6], 0) for i in range(9)], SCHEMA)).collect()
    small = [r for r in rows if r.deviation is not None]
    assert {r.vec_id for r in small} and all(r.deviation < 2**63 for r in small)
    assert {r.vec_id for r in rows} == set(range(9))


@pytest.mark.parametrize("spectrum", [np.linspace(1, 100, 400), np.concatenate([np.full(380, 1.0), np.linspace(1.001, 2, 20)]), np.array([5.0] * 12 + [1.0] * 388)])
def test_lobpcg_iterates_to_certified_residuals(spectrum):
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((400, 400)))[0]
    a, calls = (q * spectrum) @ q.T, []

    def product(block):
        calls.append(block.shape[1])
        return a @ block

    e, u, residuals = lobpcg(product, 400, 8, Params())
    assert np.allclose(e, np.sort(spectrum)[::-1][:8], rtol=1e-12) and np.abs(u.T @ u - np.eye(8)).max() < 1e-12
    assert np.linalg.norm(a @ u - u * e, axis=0).max() <= 2e-13 * e[0] and residuals.max() <= 1e-13 * e[0]
    assert max(calls) <= 24  # no product is larger than a block


def test_rounds_have_an_end():
    a = np.diag(np.linspace(1, 2, 500))
    with pytest.raises(ValueError, match="residuals"):
        lobpcg(lambda b: a @ b, 500, 8, Params(rounds=3))
