"""Tables that outlive a run, and listings of real files."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspur.functions import options
from larkspur.sources import media, track_cache


def test_cache_is_complete_only_once_written(spark, tmp_path):
    path = f"{tmp_path}/tracks"
    assert not track_cache.complete(spark, path)
    rows = spark.createDataFrame([(1, 3, 7, [1, 2], None), (2, 1, 8, None, [0.5])], "video_id long, frame_idx long, obj_id long, mask array<int>, keypoints array<double>")
    track_cache.write_tracks(rows, path)
    assert track_cache.complete(spark, path)
    meta = track_cache.read_meta(spark, path)
    assert sorted(meta.columns) == ["frame_idx", "has_mask", "obj_id", "video_id"] and {r.obj_id: r.has_mask for r in meta.collect()} == {7: True, 8: False}
    assert "keypoints" not in meta._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    track_cache.write_tracks(rows.limit(1), path)
    assert track_cache.read_tracks(spark, path).count() == 1


def test_files_by_kind(spark, tmp_path):
    for name in ("b.mp4", "a.MOV", "c.jpg", "d.txt", "e"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda want: [r.path.rsplit("/", 1)[1] for r in media.files(spark, str(tmp_path), want).collect()]
    assert names("video") == ["a.MOV", "b.mp4"] and names("image") == ["c.jpg"]
    assert media.files(spark, f"{tmp_path}/c.jpg", "image").count() == 1


def test_what_is_missing_is_an_error(spark):
    images = spark.createDataFrame([(1, "a.png")], "gid long, path string")
    with pytest.raises(PySparkException, match="no reference image for identity 2"):
        media.references(spark.createDataFrame([(1,), (2,)], "gid long"), images).collect()
    with pytest.raises(PySparkException, match="unknown layers: halo"):
        spark.range(1).select(options.checked_layers(options.layers(F.lit("boxes, halo")))).collect()


def test_corrupt_centroids_miss(spark):
    cached = spark.createDataFrame([(1, "k", [1.0, 0.0]), (2, "k", [1.0]), (3, "k", [float("nan"), 1.0]), (4, "old", [0.0, 1.0])], "gid long, content_key string, centroid array<double>")
    got = track_cache.load_centroids(spark.createDataFrame([(i, "k") for i in range(1, 6)], "gid long, content_key string"), cached, 2)
    assert {r.gid: r.centroid is not None for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_names_keep_all_digits(spark):
    rows = spark.createDataFrame([(7,), (1_234_567,)], "n long")
    assert [r[0] for r in rows.select(track_cache.frame_name(F.col("n"), 6, ".npz")).collect()] == ["000007.npz", "1234567.npz"]
