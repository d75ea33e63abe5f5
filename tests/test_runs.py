"""Run-length algebra against images."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import masks, runs
from larkspur.operators import silhouettes as S

H, W = 13, 17


def _images(n, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        m = rng.random((H, W)) < (0.1, 0.5, 0.9)[i % 3]
        if i % 4 == 0:
            m[:, 3:9] = True  # whole columns, so runs cross them
        out.append(m)
    return [np.zeros((H, W), bool), np.ones((H, W), bool), *out]


@pytest.fixture(scope="module")
def table(spark):
    images = _images(14)
    rows = [(i // 4, i, masks.encode(m)) for i, m in enumerate(images)] + [(9, 99, None), (9, 98, [])]
    return images, spark.createDataFrame(rows, "frame int, obj long, runs array<int>").repartition(3)


def _pixels(segs):
    return {(s["x"], y) for s in segs for y in range(s["y0"], s["y1"])}


def test_batches_of_runs():
    images = _images(40)
    lists = pa.array([masks.encode(m) for m in images] + [None, [], [5, 0, 0, 3, 0, 2]], pa.list_(pa.int32()))
    cut = runs.cut(lists, H).to_pylist()
    for m, got in zip(images, cut, strict=False):
        assert _pixels(got) == set(zip(*np.nonzero(m.T), strict=True)) and got == sorted(got, key=lambda s: (s["x"], s["y0"]))
    assert cut[-3:] == [None, [], [{"x": 0, "y0": 5, "y1": 8}, {"x": 0, "y0": 8, "y1": 10}]]
    codes = runs.encoded(lists).to_pylist()
    assert codes == [masks.compressed(x) if x is not None else None for x in lists.to_pylist()]
    assert runs.decoded(pa.array(codes)).to_pylist() == lists.to_pylist()
    wide = pa.array([[0, 100_000, 1, 70_000, 2_000_000, 3], [1 << 30, 1, 1 << 30, 5]], pa.list_(pa.int32()))
    assert runs.encoded(wide).to_pylist() == [masks.compressed(x) for x in wide.to_pylist()]
    assert runs.decoded(runs.encoded(wide)).to_pylist() == wide.to_pylist()
    part = lists.slice(5, 7)
    assert runs.decoded(runs.encoded(part)).to_pylist() == part.to_pylist() and runs.cut(part, H).to_pylist() == cut[5:12]
    assert runs.cut(lists.slice(0, 0), H).to_pylist() == [] and runs.decoded(pa.array([], pa.string())).to_pylist() == []


def test_runs_of_segments_give_them_back(spark, table):
    images, t = table
    back = t.withColumn("segs", runs.segments(F.col("runs"), H)).withColumn("back", runs.of_segments(F.col("segs"), H, W))
    got = {r.obj: r.back for r in back.collect()}
    assert [got[i] for i in range(16)] == [masks.encode(m) for m in images] and got[98] == [H * W] and got[99] is None


def test_boxes_and_areas(spark, table):
    images, t = table
    got = {r.obj: (r.box, r.n) for r in t.select("obj", S.tight_boxes(F.col("runs"), H).alias("box"), S.area(F.col("runs")).alias("n")).collect()}
    for i, m in enumerate(images):
        assert got[i] == (list(masks.tight_box(m)), int(m.sum()))
    assert got[99] == (None, None) and got[98] == ([0, 0, 0, 0], 0)


@pytest.mark.parametrize("scale", [1.0, 0.25, 0.6])
def test_all_pairs_of_a_frame(spark, table, scale):
    images, t = table
    segs = S.segments(t, ["frame", "obj"], H)
    got = {(r.a, r.b): r.iou for r in S.pair_iou(t.select("frame", "obj"), S.shrunk(segs, (H, W), scale) if scale < 1 else segs, ["frame"], "obj").collect()}
    small = [masks.shrunk(m, scale) for m in images]
    want = {(i, j): masks.iou(small[i], small[j]) for i in range(16) for j in range(i + 1, 16) if i // 4 == j // 4}
    assert got.keys() == {*want, (98, 99)} and got.pop((98, 99)) == 0 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_intrusion(spark, table):
    images, t = table
    boxes = t.where("obj < 90").withColumns({"x1": (F.col("obj") % 9 - 2).cast("int"), "y1": (F.col("obj") % 5).cast("int"), "x2": (F.col("obj") % 9 + 4).cast("int"), "y2": F.lit(9)})
    got = {}
    for r in S.intrusion(boxes, S.segments(t, ["frame", "obj"], H), ["frame"], "obj", W, H).collect():
        got.setdefault(r.obj, []).append(r)
    for i in range(16):
        box = (max(0, i % 9 - 2), i % 5, i % 9 + 4, 9)
        want = masks.intrusion(images[i], box, [images[j] for j in range(16) if j != i and j // 4 == i // 4])
        assert _pixels(got.get(i, [])) == set(zip(*np.nonzero(want.T), strict=True))


def test_layers_and_coverage(spark, table):
    images, t = table
    segs = S.segments(t, ["frame", "obj"], H)
    top = np.full((4, H, W), -1)
    seen = np.zeros((4, H, W), int)
    for i, m in enumerate(images):
        top[i // 4][m] = i
        seen[i // 4] += m
    got, n = np.full((4, H, W), -1), np.zeros((4, H, W), int)
    for r in S.on_top(segs, ["frame"], "obj").collect():
        got[r.frame, r.y0 : r.y1, r.x] = r.obj
    for r in S.coverage(segs, ["frame"], {"n": F.lit(1)}).collect():
        n[r.frame, r.y0 : r.y1, r.x] = r.n
    assert (got == top).all() and (n == seen).all()


@pytest.mark.parametrize("grown", [0, 1, 2, 3])
def test_points_on_grown_masks(spark, table, grown):
    images, t = table
    points = [(i, x, y) for i in range(16) for x in range(-2, W + 2) for y in range(-2, H + 2)]
    p = spark.createDataFrame(points, "obj long, x int, y int")
    got = sorted((r.obj, r.x, r.y) for r in S.points_on(p, S.segments(t, ["obj"], H), ["obj"], grown, (H, W)).collect())
    want = [q for q in points if masks.gated(np.array([[q[1], q[2]]], float), np.ones(1), images[q[0]], grown)[0] > 0]
    assert got == sorted(want)


def test_no_image_is_decoded(spark):
    """The mask queries run on columns: no plan holds Python but the Arrow functions that read and write run lengths."""
    import __spark_entry__ as entry

    for name in ("q_j7_mask_iou", "q_j8_intrusion", "q_u3_frame_masks", "q_i8_composite", "q_p27_gated_joints"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("BatchEvalPython", "MapInArrow", "FlatMapGroups", "CartesianProduct"))
