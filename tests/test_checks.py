"""A test for each error that ends a job, and that nothing else does."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspur.operators import checks


def _gallery(spark, folders, images, faces):
    return checks.gallery(spark.createDataFrame([(f,) for f in folders], "folder string"), spark.createDataFrame(images, "folder string, path string"), spark.createDataFrame([(f,) for f in faces], "path string")).collect()


def test_gallery_is_numbered_by_folder(spark):
    names = [f"p{i:03d}" for i in range(57)]
    got = _gallery(spark, reversed(names), [(n, f"{n}/{k}") for n in names for k in range(3)] + [("stray", "stray/1")], [f"{n}/1" for n in names] * 2)
    assert sorted(map(tuple, got)) == [(i, n, 3, 2) for i, n in enumerate(names)]


@pytest.mark.parametrize(
    ("folders", "images", "faces", "message"),
    [
        ([], [("a", "a/1")], ["a/1"], "the gallery has no folders of identities"),
        (["a", "b"], [("a", "a/1")], ["a/1"], "no images in b"),
        (["a", "b"], [("a", "a/1"), ("b", "b/1")], ["a/1"], "no face in any image of b"),
    ],
)
def test_gallery_errors(spark, folders, images, faces, message):
    with pytest.raises(PySparkException, match=message):
        _gallery(spark, folders, images, faces)


ROWS = [(1, 0, 5, -1), (1, 0, 6, 3), (1, 1, 5, 2), (2, 0, 5, 4)]


def _overridden(spark, overrides, known=None):
    rows = spark.createDataFrame(ROWS, "video_id long, frame_idx long, obj_id long, gid long")
    table = spark.createDataFrame(overrides, "video_id long, obj_id long, set_gid long")
    return checks.overridden(rows, table, ["video_id", "obj_id"], None if known is None else spark.createDataFrame([(g,) for g in known], "gid long")).collect()


def test_overrides(spark):
    got = _overridden(spark, [(1, 5, 7), (1, 6, None)], [7])
    assert sorted(map(tuple, got)) == [(1, 0, 5, 7, True), (1, 0, 6, 3, False), (1, 1, 5, 7, True), (2, 0, 5, 4, False)]
    assert sorted(map(tuple, _overridden(spark, []))) == [(*r, False) for r in ROWS]


@pytest.mark.parametrize(
    ("overrides", "known", "message"),
    [([(2, 6, 1)], None, "an override names an unknown object: video_id 2, obj_id 6"), ([(1, 5, 1), (1, 5, 2)], None, "two overrides of one object: video_id 1, obj_id 5"), ([(1, 5, 9)], [7], "an override names an unknown identity: 9"), ([(1, None, 1)], None, "unknown object: video_id 1, obj_id null")],
)
def test_override_errors(spark, overrides, known, message):
    with pytest.raises(PySparkException, match=message):
        _overridden(spark, overrides, known)


def test_checks_pass_rows_through(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert checks.not_empty(df, "none").collect() == df.collect()
    with pytest.raises(PySparkException, match="nothing is here"):
        checks.not_empty(df.where("false"), "nothing is here").collect()
    assert checks.none_of(df, df.where("x > 100"), F.lit("large")).count() == 5
    with pytest.raises(PySparkException, match="large: 8"):
        checks.none_of(df, df.where("x > 7"), F.concat(F.lit("large: "), F.col("x"))).collect()
