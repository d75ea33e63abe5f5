"""Colours of image bytes against numpy over all pixels at once."""

import numpy as np
from pyspark.sql import functions as F

from larkspur.functions import masks
from larkspur.operators import colour

W = 7


def _table(spark):
    rng = np.random.default_rng(6)
    rows, images = [], []
    for i in range(12):
        h = 3 + i % 4
        rgb, mask = rng.integers(0, 256, (h, W, 3), np.uint8), rng.random((h, W)) < (0.0 if i == 4 else 0.6)
        images.append((i % 3 if i != 4 else 9, rgb, mask))
        rows.append((images[-1][0], i, bytearray(rgb.tobytes()), bytearray(mask.astype(np.uint8).tobytes())))
    return images, spark.createDataFrame([*rows, (5, 50, None, bytearray(b"x")), (5, 51, bytearray(W * 3), None)], "g long, i long, rgb binary, mask binary").repartition(4)


def _lab(rgb):
    return np.clip(np.rint(masks.lab(rgb)), 0, 255)


def test_stats_add_up_over_pictures(spark):
    images, t = _table(spark)
    m = t.withColumn("moments", colour.moments(F.col("rgb"), F.col("mask"), F.lit(W)))
    got = {r.g: r for r in colour.stats(m, ["g"]).collect()}
    for g in (0, 1, 2):
        x = np.concatenate([_lab(rgb)[mask] for k, rgb, mask in images if k == g])
        assert got[g].n == len(x)
        assert np.allclose([got[g][f"{c}_mean"] for c in "lab"], x.mean(axis=0)) and np.allclose([got[g][f"{c}_std"] for c in "lab"], x.std(axis=0))
    assert got[9].n == 0 and got[9].l_mean is None and got[5].n == 0 and got[5].a_std is None


def test_match(spark):
    images, t = _table(spark)
    t = t.where("i < 12")
    s = colour.stats(t.withColumn("moments", colour.moments(F.col("rgb"), F.col("mask"), F.lit(W))), ["g"]).select("g", colour.six().alias("own"))
    to = F.array(*[F.lit(float(v)) for v in (120, 130, 125, 20, 5, 7)])
    j = t.join(s, "g")
    for only in (False, True):
        got = {r.i: bytes(r.x) for r in j.select("i", colour.matched(F.col("rgb"), F.col("mask"), F.lit(W), F.when(F.col("g") != 9, F.col("own")), to, only).alias("x")).collect()}
        stats = {g: np.concatenate([_lab(rgb)[mask] for k, rgb, mask in images if k == g] or [np.zeros((0, 3))]) for g in (0, 1, 2)}
        for i, (g, rgb, mask) in enumerate(images):
            x = _lab(rgb)
            if g != 9:
                x[mask] = masks.match_colour(x[mask], stats[g].mean(axis=0), stats[g].std(axis=0), np.array([120.0, 130, 125]), np.array([20.0, 5, 7]), only)
            assert got[i] == np.clip(np.round(x, 6), 0, 255).astype(np.uint8).tobytes()


def test_middle_of_a_reference(spark):
    r = spark.range(1).select(colour.middle(F.lit(20), F.lit(10)).alias("m")).first()
    on = np.frombuffer(bytes(r.m), np.uint8).reshape(20, 10)
    assert on.sum() == 13 * 6 and on[6:19, 2:8].all()


def test_moments_of_painted_pixels_alone():
    """All pictures of a step at once against each by itself; null pictures and masks are null, unpainted ones zeros."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    pics = [rng.integers(0, 256, (4, 5, 3)).astype(np.uint8) for _ in range(5)]
    on = [rng.random((4, 5)) < 0.4 for _ in pics]
    on[2][:] = False
    rgb = pa.array([p.tobytes() for p in pics[:4]] + [None, pics[4].tobytes()], pa.binary())
    mask = pa.array([m.astype(np.uint8).tobytes() for m in on[:4]] + [on[4].astype(np.uint8).tobytes(), None], pa.binary())
    got = colour._moments(rgb, mask, pa.array([5] * 6)).to_pylist()
    for p, m, r in zip(pics[:4], on[:4], got, strict=False):
        x = np.clip(np.rint(masks.lab(p)), 0, 255)[m].astype(int)
        assert list(r.values()) == [len(x), *x.sum(axis=0), *np.square(x).sum(axis=0)]
    assert got[4:] == [None, None]


def test_pictures_are_drawn_by_steps(monkeypatch):
    """What a kernel of pictures holds doesn't follow from the batch."""
    import pyarrow as pa
    from larkspur.functions import runs

    seen = []
    monkeypatch.setattr(runs, "STEP", 512)
    f = runs.by_steps(lambda rgb, mask, width: seen.append(len(rgb)) or colour._moments(rgb, mask, width))
    n = 1200
    out = f(pa.array([bytes(3)] * n, pa.binary()), pa.array([b"\1"] * n, pa.binary()), pa.array([1] * n))
    assert len(out) == n and max(seen) == 512


def test_a_colour_is_turned_once(monkeypatch):
    """Pictures of any sizes in one step, rows without picture, mask or moments: as each by itself, and no work for colours met before."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    pics = [rng.integers(0, 3, (2 + i % 3, 4, 3)).astype(np.uint8) * 90 for i in range(40)]
    on = [rng.random(p.shape[:2]) < (0.0 if i == 7 else 0.5) for i, p in enumerate(pics)]
    own = [[100.0 + i % 2, 120, 130, 9, 8, 7] if i % 5 else None for i in range(40)]
    own[6] = [None] * 6
    to = [120.0, 130, 125, 20, 5, 7]
    rows = (pa.array([p.tobytes() for p in pics] + [None, bytes(3)], pa.binary()), pa.array([m.astype(np.uint8).tobytes() for m in on] + [b"x", None], pa.binary()))
    rest = (pa.array([4] * 42), pa.array([*own, to, to], pa.list_(pa.float64())), pa.array([to] * 42, pa.list_(pa.float64())))
    worked = []
    lab = masks.lab
    monkeypatch.setattr(masks, "lab", lambda rgb: worked.append(len(rgb)) or lab(rgb))
    for only in (False, True):
        got = colour._matched(*rows, *rest, only)
        got.validate(full=True)
        assert got[40].as_py() is None and got[41].as_py() is None
        for i, (p, m, s) in enumerate(zip(pics, on, own, strict=True)):
            x = np.clip(np.rint(lab(p)), 0, 255)
            if s is not None and i != 6:
                x[m] = masks.match_colour(x[m], *np.array(s).reshape(2, 3), *np.array(to).reshape(2, 3), only)
            assert got[i].as_py() == np.clip(np.round(x, 6), 0, 255).astype(np.uint8).tobytes()
    assert sum(worked) <= 27
    assert [r is None for r in colour._moments(*rows, rest[0]).to_pylist()] == [False] * 40 + [True] * 2
    assert sum(worked) <= 27


def test_sums_of_bytes():
    import pyarrow as pa
    from larkspur.plans.silhouettes import _bytes_sum

    data = pa.array([b"", b"\1\2", b"", b"\xff" * 5, b""], pa.binary())
    assert _bytes_sum(data).to_pylist() == [0, 3, 0, 1275, 0] and _bytes_sum(data.slice(3, 1)).to_pylist() == [1275] and _bytes_sum(data.slice(0, 0)).to_pylist() == []
