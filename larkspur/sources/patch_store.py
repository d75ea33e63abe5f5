"""Patches of stitched pictures as an append-only table: pixels of a box, by video, object, frame and window.

``<path>/patches`` holds one folder per append and in it one per video and stretch of 256 frames, so overlays read the
stretches they need. ``<path>/commits`` lists what each append has added. An append writes what is not listed yet and is
listed last; what a failed one has left is never read, and doing an append again adds nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runs import by_steps

KEY = ["video_id", "obj_id", "frame_idx", "window_idx"]
STRETCH = 256  # frames of a folder
PATCH = "struct<y0:int,x0:int,y1:int,x1:int,rgb:binary,mask:binary,painted:int>"


def _images(column: pa.Array, heights: np.ndarray, widths: np.ndarray, channels: int) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer(), np.uint8).reshape(h, w, channels) for b, h, w in zip(column, heights, widths, strict=True)]


def _cropped(height: pa.Array, width: pa.Array, source: pa.Array, stitched: pa.Array, painted: pa.Array) -> pa.Array:
    h, w = (c.to_numpy(zero_copy_only=False) for c in (height, width))
    out = []
    for old, new, mask in zip(_images(source, h, w, 3), _images(stitched, h, w, 3), _images(painted, h, w, 1), strict=True):
        mask = mask[..., 0] > 0
        changed = (old != new).any(axis=2) | mask
        ys, xs = np.flatnonzero(changed.any(axis=1)), np.flatnonzero(changed.any(axis=0))
        y0, y1, x0, x1 = (int(ys[0]), int(ys[-1]) + 1, int(xs[0]), int(xs[-1]) + 1) if len(ys) else (0, 0, 0, 0)
        part = mask[y0:y1, x0:x1]
        out.append({"y0": y0, "x0": x0, "y1": y1, "x1": x1, "rgb": new[y0:y1, x0:x1].tobytes(), "mask": np.packbits(part).tobytes(), "painted": int(part.sum())})
    kinds = [(n, pa.int32()) for n in ("y0", "x0", "y1", "x1")] + [("rgb", pa.binary()), ("mask", pa.binary()), ("painted", pa.int32())]
    return pa.array(out, pa.struct(kinds))


def cropped(height: Column, width: Column, source: Column, stitched: Column, painted: Column) -> Column:
    """What a stitched picture is stored by: the box of what differs from its source or is painted, its pixels and its mask."""
    return F.arrow_udf(by_steps(_cropped), PATCH)(height, width, source, stitched, painted)


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    try:
        commits = spark.read.parquet(f"{path}/commits")
        return spark.read.parquet(f"{path}/patches"), commits
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # a new store, or one whose first append failed
            return None, None
        raise


def append(patches: DataFrame, path: str) -> str | None:
    """Adds patches(KEY, patch) whose key the store hasn't; of several rows of a key the one with the most painted pixels. The append's name, null if nothing was new."""
    spark, run = patches.sparkSession, uuid.uuid4().hex
    one = patches.groupBy(*KEY).agg(F.max_by("patch", F.struct("patch.painted", "patch.y0", "patch.x0", "patch.rgb")).alias("patch"))
    _, commits = _parts(spark, path)
    new = one if commits is None else one.join(commits.select(*KEY), KEY, "left_anti")
    folder = f"{path}/patches/run={run}"
    stretch = F.floor(F.col("frame_idx") / STRETCH).cast("long")
    new.withColumn("stretch", stretch).repartition("video_id", "stretch").write.partitionBy("video_id", "stretch").parquet(folder)
    try:
        written = spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # nothing was new
            return None
        raise
    listed = written.select(*[F.col(c).cast("long").alias(c) for c in KEY], F.lit(run).alias("run"), F.col("patch.painted").alias("painted"))
    listed.write.mode("append").parquet(f"{path}/commits")
    return run


def read(spark: SparkSession, path: str, videos: list[int] | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
    """(KEY, patch) of what has been committed, of some videos and of frames [from, to): folders of others are not read."""
    patches, commits = _parts(spark, path)
    if patches is None:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in KEY) + f", patch {PATCH}")
    if videos is not None:
        patches = patches.where(F.col("video_id").isin(*videos))
    if frames is not None:
        lo, hi = frames
        patches = patches.where((F.col("stretch") >= lo // STRETCH) & (F.col("stretch") <= (hi - 1) // STRETCH) & (F.col("frame_idx") >= lo) & (F.col("frame_idx") < hi))
    runs = commits.select("run").distinct()  # a row for each append
    return patches.join(F.broadcast(runs), "run", "left_semi").select(*[F.col(c).cast("long").alias(c) for c in KEY], "patch")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(KEY, painted): frames of the store and how much is painted in them; pixels are not read."""
    _, commits = _parts(spark, path)
    return spark.createDataFrame([], ", ".join(f"{c} long" for c in KEY) + ", painted int") if commits is None else commits.drop("run")


def _overlaid(width: pa.Array, source: pa.Array, crop: pa.Array, patch: pa.Array) -> pa.Array:
    out = []
    for w, s, c, p in zip(width.to_pylist(), source, crop.to_pylist(), patch.to_pylist(), strict=True):
        y0, x0, y1, x1 = c
        img = np.frombuffer(s.as_buffer(), np.uint8).reshape(-1, w, 3)[y0:y1, x0:x1].copy()
        if p is not None and p["y1"] > p["y0"]:
            a, b = (max(y0, p["y0"]), max(x0, p["x0"])), (min(y1, p["y1"]), min(x1, p["x1"]))
            if b[0] > a[0] and b[1] > a[1]:
                rgb = np.frombuffer(p["rgb"], np.uint8).reshape(p["y1"] - p["y0"], p["x1"] - p["x0"], 3)
                img[a[0] - y0 : b[0] - y0, a[1] - x0 : b[1] - x0] = rgb[a[0] - p["y0"] : b[0] - p["y0"], a[1] - p["x0"] : b[1] - p["x0"]]
        out.append(img.tobytes())
    return pa.array(out, pa.binary())


def overlaid(width: Column, source: Column, crop: Column, patch: Column) -> Column:
    """The pixels of a crop (array y0, x0, y1, x1, inside the picture) of the source with a patch over it where both meet; without one, the crop."""
    return F.arrow_udf(by_steps(_overlaid), "binary")(width, source, crop, patch)
