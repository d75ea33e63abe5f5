"""Patches come back pixel by pixel, are written once, and are read from the folders that hold them."""

import numpy as np
from pyspark.sql import functions as F

from larkspur.functions import masks
from larkspur.sources import patch_store

H, W = 11, 14
SCHEMA = "video_id long, obj_id long, frame_idx long, window_idx long, height int, width int, source binary, stitched binary, mask binary"


def _scene(spark, keys, seed=0):
    rng = np.random.default_rng(seed)
    rows, images = [], {}
    for i, key in enumerate(keys):
        old = rng.integers(0, 256, (H, W, 3), np.uint8)
        new, mask = old.copy(), np.zeros((H, W), bool)
        if i % 4:
            mask[2 + i % 5 : 7, 3:9] = rng.random((5 - i % 5, 6)) < 0.5
            new[mask] = rng.integers(0, 256, 3, np.uint8)
            new[1 + i % 3, 10] += 1  # a feather: differs without being painted
        images[key] = (old, new, mask)
        rows.append((*key, H, W, *(bytearray(x.astype(np.uint8).tobytes()) for x in (old, new, mask))))
    t = spark.createDataFrame(rows, SCHEMA).repartition(3)
    patch = patch_store.cropped(*[F.col(c) for c in ("height", "width", "source", "stitched", "mask")])
    return images, t, t.select(*patch_store.KEY, patch.alias("patch"))


def test_round_trip_and_resume(spark, tmp_path):
    path = str(tmp_path / "store")
    keys = [(v, o, f, f // 9) for v in (1, 2) for o in (0, 5) for f in (0, 3, 255, 256, 700)]
    images, table, patches = _scene(spark, keys)
    assert patch_store.read(spark, path).collect() == [] and patch_store.stored(spark, path).collect() == []
    first = patch_store.append(patches.where("video_id = 1"), path)
    assert first and patch_store.append(patches, path) and patch_store.append(patches, path) is None  # a second run adds what is new, a third nothing
    got = {tuple(r[c] for c in patch_store.KEY): r.patch for r in patch_store.read(spark, path).collect()}
    assert sorted(got) == sorted(keys)
    for key, (old, new, mask) in images.items():
        p = got[key]
        box = masks.patch_box((old != new).any(axis=2), mask)
        assert (p.y0, p.x0, p.y1, p.x1) == box and p.painted == mask.sum()
        y0, x0, y1, x1 = box
        assert bytes(p.rgb) == new[y0:y1, x0:x1].tobytes()
        bits = np.unpackbits(np.frombuffer(p.mask, np.uint8))[: (y1 - y0) * (x1 - x0)].reshape(y1 - y0, x1 - x0)
        assert (bits == mask[y0:y1, x0:x1]).all()
    assert {tuple(r[:4]): r.painted for r in patch_store.stored(spark, path).collect()} == {k: int(m.sum()) for k, (_, _, m) in images.items()}
    back = table.join(patch_store.read(spark, path), patch_store.KEY)
    crop = F.array(*[F.lit(x) for x in (1, 2, 8, 12)])
    whole = F.array(*[F.lit(x) for x in (0, 0, H, W)])
    over = lambda c: patch_store.overlaid(F.col("width"), F.col("source"), c, F.col("patch"))
    for r in back.select(*patch_store.KEY, over(whole).alias("whole"), over(crop).alias("crop")).collect():
        old, new, _ = images[tuple(r[:4])]
        assert bytes(r.whole) == new.tobytes() and bytes(r.crop) == new[1:8, 2:12].tobytes()


def test_what_failed_is_never_read(spark, tmp_path):
    path = str(tmp_path / "store")
    _, _, patches = _scene(spark, [(1, 0, f, 0) for f in range(4)])
    half = patches.where("frame_idx < 2").withColumn("stretch", F.lit(0))
    half.write.partitionBy("video_id", "stretch").parquet(f"{path}/patches/run=lost")  # an append that died before its commit
    assert patch_store.read(spark, path).count() == 0
    assert patch_store.append(patches, path) and patch_store.read(spark, path).count() == 4
    assert patch_store.append(patches.unionByName(patches), path) is None


def test_reads_are_pruned(spark, tmp_path):
    path = str(tmp_path / "store")
    _, _, patches = _scene(spark, [(v, 0, f, 0) for v in (1, 2, 3) for f in range(0, 1500, 100)])
    patch_store.append(patches, path)
    some = patch_store.read(spark, path, videos=[2], frames=(250, 520))
    assert sorted((r.video_id, r.frame_idx) for r in some.collect()) == [(2, 300), (2, 400), (2, 500)]
    assert any("video_id=2/stretch=1" in f for f in some.inputFiles())
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "stretch" in plan.split("PartitionFilters: [")[1].split("]")[0]
