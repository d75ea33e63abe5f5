"""Links and components against all cosines, and what searches of a graph miss."""

import numpy as np
import pytest

from larkspur.llm import hnsw
from larkspur.llm.near_vectors import Params, index, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, n_links int"


def _plain(rows, similarity=0.95):
    ids = [i for i, _ in rows]
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = {k: np.array(np.float32(rows[k][1]), np.float64) for k in good}
    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= similarity:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, n, least.get(find(k)), i is not None and least[find(k)] == i) for k, (i, n) in enumerate(zip(ids, links, strict=True))), key=str)


def _cloud(n, dim, seed=0):
    """Vectors apart, pairs, chains, a tight and a loose group."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    step = lambda v, a: v / np.linalg.norm(v) * np.cos(a) + np.sin(a) * (lambda u: u / np.linalg.norm(u))(rng.standard_normal(dim))
    out = list(base)
    out += [step(base[i], 0.2) for i in range(n // 5)]
    for _ in range(30):
        out.append(step(out[-1], 0.25))  # a chain, whose ends are far apart
    out += [step(base[0], 0.1) for _ in range(150)] + [step(base[1], 0.22) for _ in range(150)]
    return [np.float32(v * 3).tolist() for v in out]


@pytest.mark.parametrize("params", [Params(), Params(shards=1), Params(shards=3, shard_bytes=40_000), Params(similarity=0.8)])
def test_against_all_cosines(spark, params):
    rows = [(1000 - i, v) for i, v in enumerate(_cloud(300, 16))]
    got = near_duplicates(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA).repartition(5), params)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain(rows, params.similarity)


def test_edges(spark):
    bad = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [*enumerate(bad), (None, None), (10, [1.0, 0.0]), (11, [2.0, 0.0]), (11, [2.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [1.0]), (14, [5.0]), (15, [-1.0]), (None, [0.0, 1.0]), (None, [0.0, 3e38]), (16, [1e-40, 0.0]), (None, [1.0, 0.01])]
    got = near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _plain(rows)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert near_duplicates(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect() == [(1, 0, 1, True)]


def test_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    assert sorted((tuple(r) for r in near_duplicates(table).collect()), key=str) == _plain(rows)


def test_recall_of_whole_table(spark):
    """Rows of a table of ten thousand against all cosines: at least 0.9 is asked for; the audits ask for more."""
    table = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    unit = np.array([r.embedding for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {r.vec_id: int((unit @ u >= 0.95).sum()) - 1 for r, u in zip(rows, unit, strict=True)}
    got = {r.vec_id: r.n_links for r in near_duplicates(table).collect()}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 0


def test_audits_are_kept_with_the_index(spark):
    nodes = spark.createDataFrame([(i, v, 1) for i, v in enumerate(_cloud(400, 16))], "node long, vec array<float>, weight long")
    rows = index(nodes, Params(shards=2)).select("dim", "shard", "beam", "recall").collect()
    assert len(rows) == 2 and all(r.recall >= Params().recall and r.beam >= Params().beam for r in rows)


def test_graph_holds_every_row_and_widens_beams():
    units = np.array(_cloud(500, 24), np.float32)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    graph, leaders, node_of = hnsw.build(units, 0.97)
    assert graph.n == len(leaders) and (node_of >= 0).all() and (node_of[leaders] == np.arange(graph.n)).all()
    assert (np.einsum("nd,nd->n", units, units[leaders][node_of]) >= 0.97 - 1e-5).all()
    least = np.full(len(units), 0.3, np.float32)  # far more finds than a beam of 16 holds
    q, found = graph.within(units, least, 16)
    all_pairs = (units @ graph.units.T >= 0.3).sum()
    assert len(q) == len(set(zip(q.tolist(), found.tolist(), strict=True))) and len(q) >= 0.99 * all_pairs
