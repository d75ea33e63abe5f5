import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import assign, geom, masks
from larkspur.functions.pool import Pool
from larkspur.operators import gates, resolver, sequence, smooth


@pytest.mark.parametrize("seed", range(30))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2).tolist()
    cost = np.round(rng.random((n, m)), 1)
    pairs = assign.solve(cost)
    best = min(sum(cost[r, c] for r, c in zip(rows, cols)) for rows in itertools.combinations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m)))
    assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs) == min(n, m)
    assert abs(sum(cost[r, c] for r, c in pairs) - best) < 1e-9


def test_greedy_breaks_ties_from_the_end():
    assert assign.greedy([(0.5, 0, 0), (0.5, 1, 0), (0.9, 0, 1)]) == [(0, 1), (1, 0)]


def test_pool_bounds():
    rng = np.random.default_rng(1)
    p = Pool(cap=4, anchors=2, dedup=0.99)
    first = []
    for i in range(30):
        v = rng.normal(size=8)
        v /= np.linalg.norm(v)
        p.write(v)
        first += [v] if i < 2 else []
        assert len(p.vectors) <= 4
    assert all(any((u == v).all() for u in p.vectors) for v in first)
    assert p.write(p.vectors[0]) == "duplicate"
    assert Pool(cap=1, anchors=1, vectors=[np.array([1.0, 0])], anchored=[True]).write(np.array([0, 1.0])) == "full"


def test_windows_golden(spark):
    want = {
        0: [], 4: [], 5: [(0, 4)], 6: [(1, 5)], 48: [(3, 47)], 49: [(0, 48)], 50: [(1, 49)], 53: [(0, 48), (36, 52)], 85: [(0, 48), (36, 84)], 86: [(0, 48), (37, 85)],
        100: [(0, 48), (36, 84), (75, 99)], 121: [(0, 48), (36, 84), (72, 120)], 122: [(0, 48), (36, 84), (73, 121)],
    }
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", sequence.windows(F.col("n")).alias("w")).collect()
    assert {r.n: [tuple(w) for w in r.w] for r in got} == want


@pytest.mark.parametrize("length,overlap", [(49, 13), (9, 2), (5, 4), (17, 6)])
def test_windows_against_the_loop(spark, length, overlap):
    def loop(n):
        out, stride, i = [], max(1, length - overlap), 0
        while True:
            size = ((min(length, n - i) - 1) // 4) * 4 + 1
            if size < 5 or out and i + size - 1 <= out[-1][1]:
                break
            out.append((i, i + size - 1))
            if out[-1][1] >= n - 1:
                break
            i += stride
        if out and out[-1][1] < n - 1:
            a, b = out[-1]
            if n - 1 - (b - a) > (out[-3][1] if len(out) > 2 else -1):
                out[-1] = (n - 1 - (b - a), n - 1)
        return out

    got = spark.range(1, 220).select(F.col("id").alias("n"), sequence.windows(F.col("id"), length, overlap).alias("w")).collect()
    assert all([tuple(w) for w in r.w] == loop(r.n) for r in got)


def test_geometry_golden(spark):
    x = lambda v: F.lit(float(v))
    b = lambda *v: [x(c) for c in v]
    row = spark.range(1).select(
        geom.iou(b(0, 0, 10, 10), b(5, 0, 15, 10)).alias("third"), geom.iou(b(0, 0, 10, 10), b(10, 0, 20, 10)).alias("none"), geom.iou(b(1, 1, 1, 1), b(1, 1, 1, 1)).alias("empty"),
        F.array(*[geom.round16(x(v)) for v in (8, 24, 40, 1000)]).alias("r16"), F.array(*[geom.window_length(F.lit(v)) for v in (1, 4, 5, 8, 9, 49)]).alias("len"),
        geom.face_quality(x(0.9), x(100), x(400)).alias("q"), geom.track_id(F.lit(3), F.lit(7)).alias("t"), geom.diagonal([F.lit(None).cast("double")] * 4).alias("d"),
    ).first()
    assert row.third == pytest.approx(1 / 3) and row.none == row.empty == 0 and row.r16 == [16, 32, 32, 992] and row.len == [1, 1, 5, 5, 9, 49]
    assert row.q == pytest.approx(0.45) and row.t == 300007 and row.d == 1.0


def test_gates_golden(spark):
    v = lambda x: F.lit(x).cast("double")
    q = lambda m, s, **k: gates.mask_quality(v(m), v(100), v(s), F.lit("detection"))["kind"]
    row = spark.range(1).select(
        gates.confirmed_via(F.lit("face"), v(0.45), v(None), F.lit(9)).alias("a"), gates.confirmed_via(F.lit("osnet"), v(0.5), v(0.49), F.lit(1)).alias("b"), gates.confirmed_via(F.lit("osnet"), v(0.6), v(0.58), F.lit(3)).alias("c"),
        F.array(q(None, 1), q(90, 0.49), q(10, 0.85), q(10, 0.84)).alias("m"),
        F.array(*[gates.locality_ok(F.lit(g), v(d), F.lit(p)) for g, d, p in ((3, 301, "face"), (6, 2000, "face"), (6, 700, "osnet"), (6, 550, "osnet"), (None, None, "face"))]).alias("l"),
    ).first()
    assert (row.a, row.b, row.c) == ("face", "osnet", "none") and row.m == ["FailNone", "FailScore", "Pass", "FailRatio"] and row.l == [False, True, False, True, True]


def test_sampling_follows_the_rule(spark):
    ts = [0.0, 0.5, 1.0, 1.1, 7.0, 7.1, 7.2, 7.3, 20.0]
    want, nxt = [], 0.0
    for t in ts:
        if t >= nxt:
            want.append(t)
            nxt += 1.0
    rows = spark.createDataFrame([(1, t) for t in ts], "k int, ts double")
    assert sorted(r.ts for r in sequence.sampled(rows, ["k"], "ts", 1.0).collect()) == want


def test_chunks_and_carry(spark):
    frames = spark.createDataFrame([("a", 46), ("b", 25), ("c", 0)], "v string, n long")
    got = sequence.chunk_members(frames, "v").groupBy("v", "chunk_id").agg(F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi")).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0, 24), ("a", 1, 21, 45), ("b", 0, 0, 24)]
    rows = spark.createDataFrame([("a", 1, 1.0, 5), ("a", 7, 1.0, 5)], "v string, frame_idx long, score double, obj int")
    ghosts = sequence.carried_forward(rows, ["v"], ["obj"], F.lit(7).cast("long")).collect()
    assert sorted((g.frame_idx, round(g.score, 6)) for g in ghosts) == [(2, 0.9), (3, 0.9), (4, 0.9)]


def test_one_euro_golden(spark):
    rows = spark.createDataFrame([(1, 1, i, [x], [1.0]) for i, x in enumerate([0.0, 10.0, 10.0])], "video_id long, obj_id long, frame_idx long, xs array<double>, conf array<double>")
    got = [r.smooth[0] for r in smooth.smoothed(rows).orderBy("frame_idx").collect()]
    assert got == pytest.approx([0, 6.313250027, 8.306381202])


def test_masks_round_trip():
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (7, 5), (3, 9)):
        m = rng.random(shape) > 0.5
        assert (masks.decode(masks.encode(m), *shape) == m).all() and masks.area(masks.encode(m)) == m.sum()
    m = np.zeros((9, 9), bool)
    assert masks.tight_box(m) == (0, 0, 0, 0)
    m[2:4, 5] = True
    assert masks.tight_box(m) == (5, 2, 6, 4) and masks.dilated(m, 3).sum() == 12
    flat = np.full((9, 9, 3), 7, np.uint8)
    assert (masks.blurred(flat, m, 5) == 7).all()
    out, painted = masks.composite(flat, [{"z": 1, "y0": 0, "x0": 0, "rgb": np.full((2, 2, 3), 9, np.uint8), "mask": np.array([[1, 0], [0, 0]], bool)}, {"z": 0, "y0": 0, "x0": 0, "rgb": np.full((2, 2, 3), 8, np.uint8), "mask": np.zeros((2, 2), bool)}])
    assert out[0, 0, 0] == 9 and out[1, 1, 0] == 8 and painted.sum() == 1


def _rows(frames, **extra):
    return [{"video_id": 1, "chunk_id": f // 25, "frame_idx": f, "obj_id": 1, "x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 20.0, "face": [1.0, 0.0], "face_quality": 1.0, "face_score": 0.9, "body": None, "set_gid": None, **extra} for f in frames]


def test_resolver_confirms_inherits_and_demotes():
    r = resolver.Resolver([0, 1], np.eye(2), resolver.Params(cadence=1, consistency_score=2.0))
    out = [r([row])[0] for row in _rows(range(3))]
    assert [o["gid"] for o in out] == [-1, -1, 0]
    new = r([{**_rows([25])[0], "obj_id": 9}])[0]  # a new chunk deals new ids; the box stays
    assert new["gid"] == 0
    wrong = [r([{**row, "obj_id": 9, "face": [0.0, 1.0]}])[0] for row in _rows(range(26, 45))]
    assert any(o["demoted"] for o in wrong) and wrong[-1]["gid"] == 1


def test_resolver_keeps_identities_apart():
    r = resolver.Resolver([0], np.eye(2)[:1], resolver.Params(cadence=1))
    for f in range(4):
        a, b = _rows([f])[0], {**_rows([f])[0], "obj_id": 2, "x1": 500.0, "x2": 510.0}
        out = r([a, b])
    assert sorted(o["gid"] for o in out) == [-1, 0] and {o["abstained"] for o in out} == {None, "gid_taken"}
    forced = r([{**_rows([4])[0], "set_gid": 0}, {**_rows([4])[0], "obj_id": 2, "x1": 500.0, "x2": 510.0, "set_gid": None}])
    assert forced[0]["gid"] == 0
