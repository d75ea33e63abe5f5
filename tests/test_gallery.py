"""Gallery products against plain numpy, with the gallery in all tasks and in blocks that meet slabs of rows."""

import numpy as np
import pytest

from larkspur.operators import gallery

WAYS = [{}, {"block": 3}, {"broadcast": 0}, {"broadcast": 0, "slab": 400, "block": 5}, {"broadcast": 0, "slab": 64, "block": 1}]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    g = rng.standard_normal((23, 6))
    g[7], g[11] = g[3], g[3]  # three identities that tie
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    v = rng.standard_normal((90, 6))
    v[0], v[1] = g[3], g[3]
    v[50] = v[20]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, f"n{i}", x.tolist()) for i, x in enumerate(v)] + [(100, None, None), (101, "short", [1.0, 0.0])]
    return g, v, spark.createDataFrame(rows, "id long, name string, v array<double>").repartition(4), spark.createDataFrame([(i * 2, x.tolist()) for i, x in enumerate(g)], "gid long, centroid array<double>")


@pytest.mark.parametrize("way", WAYS)
def test_top_two(tables, way):
    g, v, rows, known = tables
    got = {r.id: r for r in gallery.top_two(rows, known, "v", ["id", "name"], **way).collect()}
    cos = np.round(v @ g.T, 12)
    for i, c in enumerate(cos):
        best = int(c.argmax())
        assert (got[i].gid, got[i].name, got[i].n_identities) == (best * 2, f"n{i}", 23)
        assert abs(got[i].assigned_sim - c[best]) < 1e-11 and abs(got[i].second_best_sim - np.delete(c, best).max()) < 1e-11
    assert got[100].gid is None and got[101].assigned_sim is None and len(got) == 92


@pytest.mark.parametrize("way", WAYS)
def test_all_pairs_and_winners(tables, way):
    g, v, rows, known = tables
    cos = np.round(v @ g.T, 12)
    got = {(r.id, r.gid): r.cos for r in gallery.similarities(rows, known, "v", ["id"], **way).collect()}
    assert len(got) == cos.size and all(abs(got[(i, 2 * j)] - cos[i, j]) < 1e-11 for i in range(len(v)) for j in range(len(g)))
    won = {r.gid: (r.best, r.winner) for r in gallery.column_winners(rows, known, "v", "id", **way).collect()}
    for j in range(len(g)):
        best = np.flatnonzero(cos[:, j] == cos[:, j].max())
        assert won[2 * j][1] == (int(best[0]) if len(best) == 1 else None) and abs(won[2 * j][0] - cos[:, j].max()) < 1e-11


def test_empty_sides(spark, tables):
    _, _, rows, known = tables
    for way in ({}, {"broadcast": -1}):
        none = gallery.top_two(rows, known.where("false"), "v", ["id"], **way).collect()
        assert len(none) == 92 and all(r.gid is None and r.n_identities == 0 for r in none)
        assert gallery.top_two(rows.where("false"), known, "v", ["id"], **way).collect() == []


def test_a_million_identities(spark):
    """A gallery beyond the broadcast's bound: each slab gets it block by block."""
    from pyspark.sql import functions as F

    angle = lambda c: F.array(F.cos(c), F.sin(c))
    known = spark.range(1_000_000).select(F.col("id").alias("gid"), angle(F.col("id") * 6e-6).alias("centroid"))
    rows = spark.range(50).select(F.col("id"), angle((F.col("id") * 17_771 + 0.25) * 6e-6).alias("v"))
    got = {r.id: r for r in gallery.top_two(rows, known, "v", ["id"], broadcast=1 << 20, slab=400).collect()}
    assert len(got) == 50 and all(abs(got[i].gid - i * 17_771) <= 1 and got[i].n_identities == 1_000_000 for i in range(50))
