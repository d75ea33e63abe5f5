"""Tracks, decoded frames and centroids as tables that outlive a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a track row keeps of the decision that named it.
ASSIGNMENT = "struct<path:string,sim:double,second_sim:double,operator:boolean>"


def frame_name(frame_idx: Column, width: int = 6, suffix: str = "") -> Column:
    """Zero-padded names sort like their numbers; numbers that need more digits keep them all."""
    text = frame_idx.cast("string")
    return F.concat(F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")), F.lit(suffix))


def tagged(value: Column, tag: str) -> Column:
    """A record as JSON text that says what it is; null stays null."""
    return F.when(value.isNotNull(), F.to_json(F.struct(F.lit(tag).alias("__type__"), value.alias("value"))))


def untagged(text: Column, tag: str, schema: str) -> Column:
    """The record of a tagged text; null for another tag or for a text that is none."""
    read = F.from_json(text, f"struct<__type__:string,value:{schema}>")
    return F.when(read["__type__"] == tag, read["value"])


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Replace the cache: one folder for each video, rows in the order of frame and object, masks apart from what is small.

    A run that fails leaves no ``_SUCCESS``, which is what complete() asks for.
    """
    tracks.repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "obj_id").write.mode("overwrite").partitionBy("video_id").parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table at this path was written to its end. Asked of the store that holds it, so any Hadoop path will do."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The rows without their masks and keypoints, and whether they have a mask. Masks are not decoded, for the column is not read whole."""
    rows = read_tracks(spark, path)
    return rows.select(*[c for c in rows.columns if c not in ("mask", "keypoints")], F.col("mask").isNotNull().alias("has_mask"))


def frame_indices(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, frame_idx) of the frames the cache has, one row each. Two columns are read."""
    return read_tracks(spark, path).select("video_id", "frame_idx").distinct()


def clamped(requests: DataFrame, counts: DataFrame, key: str, frame: str = "frame_idx") -> DataFrame:
    """Requests of a frame store with the frame they get: beyond the last one, the last; none from an empty store."""
    held = requests.join(counts.select(key, "n_frames"), key)
    return held.where("n_frames > 0").withColumn("stored_idx", F.least(F.col(frame), F.col("n_frames") - 1)).drop("n_frames")


def save_centroids(centroids: DataFrame, path: str) -> None:
    """(gid, content_key, centroid), replacing what was there."""
    centroids.select("gid", "content_key", "centroid").write.mode("overwrite").parquet(path)


def load_centroids(wanted: DataFrame, cached: DataFrame, size: int) -> DataFrame:
    """wanted(gid, content_key) with the cached centroid: null, a miss, if the key differs or the vector has not ``size`` numbers."""
    whole = cached.where((F.size("centroid") == size) & ~F.exists("centroid", lambda x: x.isNull() | F.isnan(x)))
    return wanted.join(whole.select("gid", "content_key", "centroid"), ["gid", "content_key"], "left")
