"""Media files as rows: listing by suffix, and metadata. Pixels are decoded by whoever has a decoder; frames come as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes by kind.
VIDEO = ("mp4", "avi", "mov", "mkv", "webm")
IMAGE = ("jpg", "jpeg", "png", "bmp", "webp")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*VIDEO), "video").when(s.isin(*IMAGE), "image")


def listed(paths: DataFrame, want: str) -> DataFrame:
    """The paths of one kind, with their place in the order of names. Whatever is of no kind is left out.

    The order is by range and then counted, so no listing meets in one task.
    """
    rows = paths.where(kind(F.col("path")) == want).select("path")
    return rows.sort("path")


def files(spark: SparkSession, folder: str, want: str, recursive: bool = False) -> DataFrame:
    """(path, length, modified) of the files of a kind in a folder (or of one file), by name; contents are not read."""
    names = "*.{" + ",".join(x for s in (VIDEO if want == "video" else IMAGE) for x in (s, s.upper())) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).sort("path")


def rejected(paths: DataFrame, mode: str) -> DataFrame:
    """The paths that a mode can't take: stills where videos are asked for, and the other way round."""
    other = "image" if mode == "video" else "video"
    return paths.where(kind(F.col("path")) == other).select("path")


def video_info(streams: DataFrame, start: float = 0.0, end: float | None = None, fps: float | None = None) -> DataFrame:
    """Adds out_fps, duration and n_frames to (fps, seconds, stream_frames): what a reader of this range and rate gives.

    The range is cut at the stream's end only if none is given; a range that is empty falls back to what the stream says of itself.
    """
    own = F.coalesce("seconds", F.lit(0.0))
    rate = F.lit(float(fps)) if fps else F.coalesce("fps", F.lit(0.0))
    taken = F.greatest(F.lit(0.0), (own if end is None else F.lit(float(end))) - F.lit(float(start)))
    n = F.when((rate > 0) & (taken > 0), F.bround(taken * rate).cast("long")).otherwise(F.col("stream_frames"))
    return streams.withColumns({"out_fps": rate, "duration": F.when(taken > 0, taken).otherwise(own), "n_frames": n})


def decoded(frames: DataFrame, key: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """frames(key, pts, ...) that a reader gives: those without a time are skipped, the range is half-open."""
    rows = frames.where(F.col("pts").isNotNull())
    if start is not None:
        rows = rows.where(F.col("pts") >= start)
    return rows if end is None else rows.where(F.col("pts") < end)


def missing_reference(gid: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no reference image for identity "), gid.cast("string")))


def references(targets: DataFrame, images: DataFrame) -> DataFrame:
    """targets(gid) with path of their reference image; an identity without one is an error."""
    found = targets.join(images.select("gid", "path"), "gid", "left")
    return found.withColumn("path", F.coalesce("path", missing_reference(F.col("gid"))))
