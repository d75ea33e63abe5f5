"""Blocks of a frame's masks against images: what meets pairwise without a table of segments or pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import masks, runs
from larkspur.operators import silhouettes as S

from test_runs import H, W, _images


@pytest.fixture(scope="module")
def table(spark):
    images = _images(14)
    rows = [(i // 8, i, masks.encode(m)) for i, m in enumerate(images)] + [(9, 99, None), (9, 98, [])]
    box = {"x1": F.col("obj") % 9 - 2, "y1": F.col("obj") % 5, "x2": F.col("obj") % 9 + 4, "y2": F.lit(9)}
    return images, spark.createDataFrame(rows, "frame int, obj long, runs array<int>").repartition(3).withColumns({n: c.cast("int") for n, c in box.items()})


@pytest.mark.parametrize("block", [3, 512])
def test_pairs_in_blocks(table, block):
    images, t = table
    got = {(r.a, r.b): (r.iou, r.small) for r in S.frame_pairs(t, ["frame"], "obj", (H, W), 0.25, block).collect()}
    small = [masks.shrunk(m, 0.25) for m in images]
    want = {(i, j): (masks.iou(images[i], images[j]), masks.iou(small[i], small[j])) for i in range(16) for j in range(i + 1, 16) if i // 8 == j // 8}
    assert got.pop((98, 99)) == (0, 0) and got == want


@pytest.mark.parametrize("block", [3, 512])
def test_intruded_in_blocks(table, block):
    images, t = table
    got = {r.obj: (r.removed, r.crop) for r in S.intruded(t.where("obj < 90"), ["frame"], "obj", W, H, block).withColumnRenamed("key", "obj").collect()}
    for i in range(16):
        x1, y1, x2, y2 = max(0, i % 9 - 2), i % 5, i % 9 + 4, 9
        away = masks.intrusion(images[i], (x1, y1, x2, y2), [images[j] for j in range(16) if j != i and j // 8 == i // 8])
        assert got[i] == (away.sum(), (~away[y1:y2, x1:x2]).sum())


def test_composite(table):
    images, t = table
    got = {(r.frame, r.obj): r.shown for r in S.composite(t.where("obj < 90"), ["frame"], "obj", W, H).collect()}
    want = {}
    for frame in (0, 1):
        here = sorted(range(frame * 8, frame * 8 + 8), key=lambda i: (np.flatnonzero(images[i].any(axis=1)).max(initial=-1), i))
        top = np.full((H, W), -1)
        for z, i in enumerate(here):
            if z:
                top[images[i]] = i
            else:
                top[i % 5 : 9, max(0, i % 9 - 2) : i % 9 + 4] = i
        want |= {(frame, i): int((top == i).sum()) for i in here if (top == i).any()}
    assert got == want


@pytest.mark.parametrize("dense", [False, True])
def test_common_places(dense):
    rng = np.random.default_rng(5)
    size = 20_000
    a, b = (rng.random((n, size)) < (0.9 if dense else 0.01) for n in (7, 11))
    got = S._common(*np.nonzero(a), 7, *np.nonzero(b), 11, size)
    assert (got == a.astype(int) @ b.T.astype(int)).all()


@pytest.mark.parametrize("grown", [0, 1, 2, 3])
def test_points_on_masks_of_a_batch(grown):
    images = _images(14)
    xs, ys = (v.ravel() for v in np.meshgrid(np.arange(-2, W + 2), np.arange(-2, H + 2)))
    some = [masks.encode(m) for m in images] + [None, []]
    lists = [pa.array([v.tolist()] * len(some), pa.list_(pa.int64())) for v in (xs, ys)]
    got = runs._on(pa.array(some, pa.list_(pa.int32())), *lists, grown, H, W).to_pylist()
    for m, on in zip(images, got, strict=False):
        assert on == (masks.gated(np.stack([xs, ys], 1).astype(float), np.ones(len(xs)), m, grown) > 0).tolist()
    assert not any(got[-1]) and not any(got[-2])


def test_kernels_take_a_batch_by_steps():
    sizes = []
    f = runs.by_steps(lambda a: sizes.append(len(a)) or a, 512)
    assert f(pa.array(range(1300))).to_pylist() == list(range(1300)) and sizes == [512, 512, 276] and f(pa.array([], pa.int64())).to_pylist() == []


def test_no_pairs_are_shuffled(spark):
    """No join, so nothing of unknown size is broadcast, and no table of segments or pairs."""
    import __spark_entry__ as entry

    for name in ("q_j7_mask_iou", "q_j8_intrusion", "q_i8_composite", "q_p27_gated_joints"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "segments" not in plan  # the row with the number of vectors


@pytest.mark.parametrize("height,width", [(9, 7), (64, 5), (130, 6)])
def test_masks_that_reach_a_box_by_a_table_of_pixels(height, width):
    """What boxes are looked up in gives what their pairs give, and what images do; boxes may be empty."""
    rng = np.random.default_rng(4)
    images = [rng.random((height, width)) < p for p in (0, 0.02, 0.05, 0.5, 1) for _ in range(4)]
    images = [m & (np.arange(width) // 2 == i % 4) for i, m in enumerate(images)]
    lists = pa.array([masks.encode(m) for m in images] + [None, []], pa.list_(pa.int32()))
    on = runs.bits(lists, height, width)
    unpacked = np.unpackbits(on.view(np.uint8), axis=2, bitorder="little")[:, :, :height].transpose(0, 2, 1)
    assert (unpacked[:-2] == np.stack(images)).all() and not unpacked[-2:].any()
    x1, y1 = rng.integers(0, width, 60), rng.integers(0, height, 60)
    edges = np.stack([x1, y1, np.minimum(x1 + rng.integers(0, width, 60), width), np.minimum(y1 + rng.integers(0, height, 60), height)])
    x = np.arange(width)
    box = ((x >= edges[0][:, None]) & (x < edges[2][:, None]))[:, :, None] * runs.between(edges[1], edges[3], height)[:, None, :]
    by_table = S._over(S._together(lists, (height, width)), edges)
    assert (by_table == S._reached(box.reshape(60, -1), edges, lists, (height, width))).all() and by_table.any()
    for b, (a, c, d, e) in enumerate(edges.T):
        want = np.zeros((height, width), bool)
        for m in images:
            if m[c:e, a:d].any():
                want |= m
        got = np.unpackbits(by_table[b].reshape(width, -1).view(np.uint8), axis=1, bitorder="little")[:, :height].T
        assert (got == want).all()


def test_a_crowded_frame_is_not_met_in_pairs(monkeypatch, spark):
    """1,000 boxes and masks of a frame: no pairs are made, and the rows are those of the pairs."""
    n = 1000
    t = spark.range(n).select(F.lit(0).alias("f"), F.col("id").alias("obj"), *[F.col("id").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], F.array(F.lit(1)).alias("runs"))
    rng = np.random.default_rng(9)
    x1, y1 = rng.integers(-1, 20, n), rng.integers(-1, 10, n)
    x2, y2 = x1 + rng.integers(0, 6, n), y1 + rng.integers(0, 5, n)
    images = np.zeros((n, 10, 20), bool)
    for i in range(n):
        images[i, max(0, y1[i]) : max(0, y2[i]), max(0, x1[i]) : max(0, x2[i])] = True
    images &= rng.random(images.shape) < 0.7
    columns = [pa.array(np.arange(n)), pa.array([masks.encode(m) for m in images], pa.list_(pa.int32())), pa.array(np.arange(n) < 900), *(pa.array(c.astype(np.int32)) for c in (x1, y1, x2, y2))]
    kernels = []
    arrow_udf = F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: kernels.append(f) or arrow_udf(f, kind))
    S.intruded(t, ["f"], "obj", 20, 10)
    away = kernels[0]
    monkeypatch.setattr(S, "_reached", None)
    got = np.frombuffer(away(*columns), S._LOST)
    monkeypatch.undo()
    monkeypatch.setattr(S, "MANY", n * n)
    assert (np.frombuffer(away(*columns), S._LOST) == got).all() and list(got["key"]) == list(range(900))
    i = 5
    want = masks.intrusion(images[i], tuple(np.maximum((x1[i], y1[i], x2[i], y2[i]), 0)), [m for j, m in enumerate(images) if j != i])
    assert got["removed"][i] == want.sum()


@pytest.mark.parametrize("block", [150, 2048])
def test_pairs_of_a_crowded_frame(spark, block):
    """400 masks of a frame meet by image columns, some at a time, and give what images give; keys are in no order."""
    n, h, w = 400, 8, 12
    rng = np.random.default_rng(3)
    images = rng.random((n, h, w)) < 0.4
    images &= (np.arange(w) // 4 == rng.integers(0, 3, n)[:, None])[:, None, :]
    images[7] = False
    keys = rng.permutation(n) * 10
    t = spark.createDataFrame([("x", int(k), masks.encode(m)) for k, m in zip(keys, images, strict=True)], "frame string, obj long, runs array<int>").repartition(2)
    got = {(r.a, r.b): (r.iou, r.small) for r in S.frame_pairs(t, ["frame"], "obj", (h, w), 0.5, block).collect()}
    small = images[:, np.arange(4) * 2][:, :, np.arange(6) * 2].reshape(n, -1).astype(int)
    flat = images.reshape(n, -1).astype(int)
    want = []
    for m in (flat, small):
        both = m @ m.T
        union = m.sum(axis=1)[:, None] + m.sum(axis=1) - both
        want.append(np.where(union > 0, both / np.maximum(union, 1), 0.0))
    at = {int(k): i for i, k in enumerate(keys)}
    assert len(got) == n * (n - 1) // 2
    assert all(a < b and v == (want[0][at[a], at[b]], want[1][at[a], at[b]]) for (a, b), v in got.items())


def test_pairs_are_rounded_half_up(spark):
    """As Spark's own round does, ties at the last digit too: 1 of 128 and 1 of 640."""
    h, w = 20, 32
    images = np.zeros((5, h * w), bool)
    images[0, :1], images[1, :128], images[2, :640], images[3, :3], images[4, 2:9] = True, True, True, True, True
    t = spark.createDataFrame([(1, i, masks.encode(m.reshape(h, w))) for i, m in enumerate(images)], "frame int, obj long, runs array<int>")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    exact = S.frame_pairs(t, ["frame"], "obj", (h, w), 0.25)
    got = rows(S.frame_pairs(t, ["frame"], "obj", (h, w), 0.25, digits=6))
    assert got == rows(exact.select("frame", "a", "b", F.round("iou", 6), F.round("small", 6)))
    assert {r[3] for r in got} >= {0.007813, 0.001563}
