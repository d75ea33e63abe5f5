"""Prefix operators over stretches against one window for each key, and one long video over many tasks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import prefix


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for key in (1, 2, 3, None):
        for at in sorted(rng.choice(400, 150, replace=False).tolist()):
            bad = bool(rng.random() < (0.97 if key == 1 else 0.5))
            out.append((key, at - 50, int(rng.integers(100)) if rng.random() < 0.1 else None, None if rng.random() < 0.02 else bad, [float(x) for x in rng.standard_normal(4)] if rng.random() < 0.95 else None, float(rng.integers(3))))
    out += [(7, 0, None, True, [1.0, 2.0], 1.0), (7, 90, 5, True, [1.0, None, 3.0], 1.0), (7, 95, None, True, [0.0], 2.0)]
    return spark.createDataFrame(out, "key int, at long, value int, bad boolean, v array<double>, w double").repartition(5)


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [1, 7, 64, 4096])
def test_last_value(rows, width):
    w = Window.partitionBy("key").orderBy("at")
    for own in (False, True):
        want = rows.withColumn("got", F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)))
        got = prefix.last_value(rows, ["key"], "at", F.col("value"), "got", own, width)
        assert got.columns == want.columns and _sorted(got) == _sorted(want)


@pytest.mark.parametrize("width", [1, 7, 64, 4096])
def test_streak(rows, width):
    got = {(r.key, r.at): r.n for r in prefix.streak(rows, ["key"], "at", F.col("bad"), "n", width).collect()}
    seen = 0
    last, n = object(), 0
    for r in sorted(rows.collect(), key=lambda r: (str(r.key), r.at)):
        n = (n if r.key == last else 0) + 1 if r.bad else 0
        last = r.key
        assert got[(r.key, r.at)] == n
        seen = max(seen, n)
    assert seen > 20 and len(got) == rows.count()


@pytest.mark.parametrize("width", [3, 64, 4096])
@pytest.mark.parametrize("before", [False, True])
def test_running_means(rows, width, before):
    got = {(r.key, r.at): (r.running, r.n) for r in prefix.running_means(rows, ["key"], "at", "v", F.col("w"), before, width).collect()}
    total, n, last = np.zeros(4), 0, object()
    count = 0
    for r in sorted(rows.where("v is not null").collect(), key=lambda r: (str(r.key), r.at)):
        if r.key != last:
            total, n, last = np.zeros(4), 0, r.key
        v = np.pad(np.array([x or 0.0 for x in r.v]), (0, 4 - len(r.v))) * r.w
        old, m = total, n
        total, n, count = total + v, n + (r.w > 0), count + 1
        want, k = ((old, m) if before else (total, n))
        running, seen = got[(r.key, r.at)]
        assert seen == k and (running is None) == (k == 0)
        if running is not None:
            own = want[: len(r.v)]
            assert np.allclose(running, own / max(np.linalg.norm(own), 1e-12), atol=1e-12)
    assert len(got) == count


def test_no_rows(spark, rows):
    none = rows.where("false")
    assert prefix.last_value(none, ["key"], "at", F.col("value"), "x").collect() == []
    assert prefix.streak(none, ["key"], "at", F.col("bad"), "x").collect() == []
    assert prefix.running_means(none, ["key"], "at", "v", F.col("w")).collect() == []


def test_one_long_video_is_many_tasks(spark):
    """Two million frames of one video: no task gets more than a few stretches of it, and the result is the window's."""
    n = 2_000_000
    video = spark.range(n).select(F.lit(1).alias("video"), F.col("id").alias("at"), F.when(F.col("id") % 70_001 == 0, F.col("id")).alias("value"), (F.col("id") % 300_007 != 0).alias("bad"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = prefix.last_value(video, ["video"], "at", F.col("value"), "last", own=True)
        sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) == 16 and max(r["count"] for r in sizes) < n / 8
        assert got.where(F.col("last") != F.col("at") - F.col("at") % 70_001).isEmpty() and got.count() == n
        run = prefix.streak(video, ["video"], "at", F.col("bad"), "run")
        assert run.where(F.col("run") != F.col("at") % 300_007).isEmpty() and run.count() == n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
