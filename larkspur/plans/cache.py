"""Queries on inputs, the track cache and what is chosen to be rendered, with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import options, runs, vec
from ..operators import sequence
from ..sources import bridge, frame_files, media, scratch, track_cache
from ..sources.bridge import DET_SQL

FPS = 24.0  # of the bridge's videos


def _streams(spark, sf_dir):
    """A stream for each video; every third doesn't say how long it is."""
    v = bridge.detections(spark, sf_dir).groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))
    return v.select("video_id", F.lit(FPS).alias("fps"), F.when(F.col("video_id") % 3 != 0, (F.col("n") / FPS).cast("double")).alias("seconds"), F.col("n").alias("stream_frames"))


def q_s3_video_info(spark, sf_dir):
    """What a reader that starts at second two and gives five frames a second says of each video."""
    return media.video_info(_streams(spark, sf_dir), start=2.0, fps=5.0).select("video_id", "out_fps", F.round("duration", 6).alias("duration"), "n_frames")


def _pictures(spark, sf_dir):
    """Frames with their time in seconds; every seventh has none."""
    f = bridge.detections(spark, sf_dir).select("video_id", "frame_idx").distinct()
    return f.select("video_id", "frame_idx", F.when(F.col("frame_idx") % 7 != 0, F.col("frame_idx") / FPS).alias("pts"))


def q_s2_decoded_frames(spark, sf_dir):
    return media.decoded(_pictures(spark, sf_dir), "video_id", 2.0, 20.0).select("video_id", "frame_idx", F.round("pts", 6).alias("pts"))


def q_s1_open_video(spark, sf_dir):
    """Frames of a time range at two a second: a frame is taken once its time reaches the next due one."""
    frames = media.decoded(_pictures(spark, sf_dir), "video_id", 2.0, 20.0)
    taken = sequence.sampled(frames, ["video_id"], "pts", 0.5, 2.0)
    return taken.select("video_id", "frame_idx")


def _paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    ends = F.array(*[F.lit(x) for x in ("mp4", "MOV", "jpg", "PNG", "txt", "webp", "")])
    return p.select(F.concat(F.lit("in/"), F.regexp_replace("p_name", " ", "_"), F.lit("-"), "p_partkey", F.lit("."), F.element_at(ends, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("path"))


def q_s7_video_inputs(spark, sf_dir):
    return media.listed(_paths(spark, sf_dir), "video")


def q_s7_rejected_inputs(spark, sf_dir):
    return media.rejected(_paths(spark, sf_dir), "video")


def q_s8_images(spark, sf_dir):
    return media.listed(_paths(spark, sf_dir), "image")


def q_s16_references(spark, sf_dir):
    """Identities that suppliers stand for, each with its first image; all have one."""
    images = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").cast("long").alias("gid")).agg(F.min("s_name").alias("path"))
    return media.references(images.select("gid"), images).select("gid", "path")


def _tracks(spark, sf_dir):
    m = bridge.matched(spark, sf_dir)
    info = F.struct(F.when(F.col("k") % 2 == 0, "face").otherwise("body").alias("path"), F.col("score").alias("sim"), F.when(F.col("k") % 5 != 0, F.col("score") / 2).alias("second_sim"), (F.col("k") % 10 == 0).alias("operator"))
    # A mask of the box's columns in a picture of 1000 by 2000: so many zeros, so many ones, the rest.
    mask = F.when(F.col("k") % 4 != 0, F.array(F.col("x1") * 1000 + F.col("y1"), F.col("y2") - F.col("y1"), F.lit(2_000_000) - F.col("x1") * 1000 - F.col("y2")).cast("array<int>"))
    points = F.when(F.col("k") % 3 == 0, F.array(F.col("x1") / 2.0, F.col("y1") / 2.0))
    return m.select("video_id", "frame_idx", "obj_id", "gid", "x1", "y1", "x2", "y2", "score", mask.alias("mask"), points.alias("keypoints"), track_cache.tagged(F.when(F.col("k") % 8 != 0, info), "assignment").alias("assignment"))


def _cached(spark, sf_dir):
    """The tracks as a cache of one file per frame."""
    frame_files.register(spark)
    path = scratch.new_path(spark, "tracks")
    meta = F.to_json(F.struct("obj_id", "gid", "x1", "y1", "x2", "y2", "score", "assignment"))
    size = [F.when(F.col("mask").isNotNull(), n).cast("int").alias(c) for c, n in (("height", 1000), ("width", 2000))]
    rows = _tracks(spark, sf_dir).select("video_id", "frame_idx", "obj_id", meta.alias("meta"), *size, runs.code(F.col("mask")).alias("code"), F.col("keypoints").alias("points"))
    frame_files.laid_out(rows, "obj_id", int(spark.conf.get("spark.sql.shuffle.partitions"))).write.format("larkspur_tracks").mode("overwrite").save(path)
    if not track_cache.complete(spark, path):
        raise OSError(f"the cache at {path} was not written to its end")
    return path


_TRACK = "obj_id long, gid long, x1 long, y1 long, x2 long, y2 long, score double, assignment string"


def _cache(spark, sf_dir, schema):
    return spark.read.format("larkspur_tracks").schema(schema).load(_cached(spark, sf_dir))


def q_k3_track_cache(spark, sf_dir):
    """Tracks written and read whole: masks, keypoints and the record of the decision come back."""
    t = _cache(spark, sf_dir, "video_id long, frame_idx long, meta string, code string, points array<double>").withColumn("t", F.from_json("meta", _TRACK))
    a = track_cache.untagged(F.col("t.assignment"), "assignment", track_cache.ASSIGNMENT)
    return t.select(
        "video_id", "frame_idx", "t.obj_id", "t.gid", "t.x1", "t.y2", F.array_join(runs.from_code(F.col("code")).cast("array<string>"), ",").alias("mask"),
        F.round(F.element_at("points", 1), 6).alias("joint"), a["path"].alias("path"), F.round(a["second_sim"], 6).alias("second_sim"), a["operator"].alias("operator"),
    )


def q_s11_cache_meta(spark, sf_dir):
    """Rows without their masks, which are not read."""
    t = _cache(spark, sf_dir, "video_id long, frame_idx long, meta string, has_mask boolean").withColumn("t", F.from_json("meta", _TRACK))
    return t.select("video_id", "frame_idx", "t.obj_id", "t.gid", "has_mask")


def q_s10_cache_frames(spark, sf_dir):
    """Frames of the cache by the names of its files, none of which is opened."""
    f = _cache(spark, sf_dir, "video_id long, frame_idx long")
    return f.select("video_id", "frame_idx", track_cache.frame_name(F.col("frame_idx"), 6, ".npz").alias("name"))


def q_s12_cached_range(spark, sf_dir):
    """Tracks of frames 100 to 199 of the first five videos, with the area of their masks: files of others are not opened."""
    t = _cache(spark, sf_dir, "video_id long, frame_idx long, meta string, code string").where("video_id < 5 and frame_idx >= 100 and frame_idx < 200")
    return t.select("video_id", "frame_idx", F.get_json_object("meta", "$.obj_id").cast("long").alias("obj_id"), runs.area(runs.from_code(F.col("code"))).alias("area"))


def q_f32_meta_json(spark, sf_dir):
    """The record of a decision as tagged text; another tag gives none back."""
    t = _tracks(spark, sf_dir)
    back = track_cache.untagged(F.col("assignment"), "assignment", track_cache.ASSIGNMENT)
    return t.select("video_id", "frame_idx", "obj_id", F.get_json_object("assignment", "$.__type__").alias("tag"), back["path"].alias("path"), track_cache.untagged(F.col("assignment"), "other", track_cache.ASSIGNMENT).isNull().alias("other_is_null"))


def _thumbnail(video: pa.Array, frame: pa.Array) -> pa.Array:
    """Pictures of 6 by 9 pixels, each channel counted on from the video and the frame."""
    at = [v.to_numpy(zero_copy_only=False)[:, None, None, None] for v in (video, frame)]
    y, x, c = np.ogrid[:6, :9, :3]
    rgb = ((at[0] * 31 + at[1] * 7 + x * 5 + y * 11 + c * 17) % 256).astype(np.uint8)
    return pa.array([r.tobytes() for r in rgb.reshape(len(rgb), -1)], pa.binary())


def _bytes_sum(rgb: pa.Array) -> pa.Array:
    offsets = np.frombuffer(rgb.buffers()[1], np.int32)[rgb.offset : rgb.offset + len(rgb) + 1]
    sums = np.concatenate([[0], np.cumsum(np.frombuffer(rgb.buffers()[2], np.uint8), dtype=np.int64)])
    return pa.array(sums[offsets[1:]] - sums[offsets[:-1]])


def _frame_store(spark, sf_dir):
    """Pictures that have a time, numbered from 0 in the order of time, one file each."""
    frame_files.register(spark)
    path = scratch.new_path(spark, "frames")
    by_time = Window.partitionBy("video_id").orderBy("frame_idx")
    numbered = _pictures(spark, sf_dir).withColumn("at", (F.row_number().over(by_time) - 1).cast("long"))
    rows = numbered.select("video_id", F.col("at").alias("frame_idx"), F.lit(6).alias("height"), F.lit(9).alias("width"), F.arrow_udf(_thumbnail, "binary")("video_id", "frame_idx").alias("rgb"))
    frame_files.laid_out(rows, "height", int(spark.conf.get("spark.sql.shuffle.partitions"))).write.format("larkspur_frames").mode("overwrite").save(path)
    return path


def q_k4_frame_store(spark, sf_dir):
    """Frames of a store, and how many its mark of completeness says there are."""
    path = _frame_store(spark, sf_dir)
    names = spark.read.format("larkspur_frames").schema("video_id long, frame_idx long").load(path)
    n = names.groupBy("video_id").agg(F.max("frame_idx").alias("last_idx"))
    counts = spark.read.format("larkspur_frame_counts").load(path)
    return n.join(counts, "video_id", "left").select("video_id", "n_frames", "last_idx", F.coalesce(F.col("n_frames") == F.col("last_idx") + 1, F.lit(False)).alias("complete"))


def q_s4_seek(spark, sf_dir):
    """The picture at a place of each video: equality on the frame reaches the names, so one file of a video is opened."""
    frames = spark.read.format("larkspur_frames").schema("video_id long, frame_idx long, height int, width int, rgb binary").load(_frame_store(spark, sf_dir))
    return frames.where("frame_idx = 100").select("video_id", "frame_idx", "height", "width", F.arrow_udf(_bytes_sum, "long")("rgb").alias("brightness"))


def q_s13_frame_clamp(spark, sf_dir):
    """The frames of a store that requests get, each nation asking one video for frame 7 times its key."""
    n = spark.read.format("larkspur_frame_counts").load(_frame_store(spark, sf_dir))
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") % 12).cast("long").alias("video_id"), (F.col("n_nationkey") * 7).cast("long").alias("frame_idx"))
    return track_cache.clamped(asked, n, "video_id")


def _keyed_centroids(spark, sf_dir):
    key = F.sha2(F.concat(F.lit("identity-"), F.col("gid").cast("string")), 256)
    return bridge.gallery(spark, sf_dir).withColumn("content_key", key)


def q_s17_centroid_cache(spark, sf_dir):
    """Centroids saved and loaded by content key: identities whose content has changed since miss."""
    path = scratch.new_path(spark, "cache")
    track_cache.save_centroids(_keyed_centroids(spark, sf_dir), path)
    changed = F.concat(F.lit("identity-"), F.col("gid").cast("string"), F.when(F.col("gid") % 3 == 0, "-new").otherwise(""))
    wanted = bridge.vectors(spark, sf_dir).select(F.col("label").alias("gid")).distinct().withColumn("content_key", F.sha2(changed, 256))
    got = track_cache.load_centroids(wanted, spark.read.parquet(path), 64)
    return got.select("gid", F.col("centroid").isNotNull().alias("hit"), F.round(F.element_at("centroid", 1), 6).alias("first"))


def q_p21_target_ids(spark, sf_dir):
    """Identities to render: the explicit list where a video has one (even numbers), else those confirmed in it."""
    m = bridge.matched(spark, sf_dir)
    confirmed = m.where("score >= 0.97").select("video_id", "gid").distinct()
    listed = m.select("video_id").distinct().where("video_id % 2 = 0").select("video_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (3, 1, 99)])).alias("gid"))
    return options.targets(listed, confirmed, "video_id")


def q_f29_prompts(spark, sf_dir):
    """Attributes of a person as one prompt; those that are empty or unknown are left out."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    some = F.when(F.col("p_partkey") % 4 != 0, F.lower("p_brand"))
    return p.select(F.col("p_partkey").cast("long").alias("p_partkey"), options.prompt([some, F.lower("p_type"), F.when(F.col("p_size") > 25, "tall").otherwise(" ")], "a person").alias("prompt"))


def q_f30_figures(spark, sf_dir):
    """Figure specs parsed: layers in order, the figure's key, and layers nobody knows."""
    s = _specs(spark, sf_dir)
    layers = options.layers(F.col("spec"))
    return s.select("spec", F.array_join(layers, ",").alias("layers"), options.figure_key(layers).alias("figure"))


def _specs(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pick = F.element_at(F.array(F.lit("masks, boxes"), F.lit(" blur,,faces "), F.lit("boxes"), F.lit("tracks,halo")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return n.select(F.concat(pick, F.when(F.col("n_nationkey") % 5 == 0, ", labels").otherwise("")).alias("spec")).distinct()


def q_u6_unknown_layers(spark, sf_dir):
    """Layers that specs use and nobody draws."""
    s = _specs(spark, sf_dir)
    return s.select("spec", F.explode(options.unknown_layers(options.layers(F.col("spec")))).alias("layer"))


def q_z8_gate_thresholds(spark, sf_dir):
    """Thresholds of a gate from settings: all three or none."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    has = lambda m, k, v: F.when(F.col("n_nationkey") % m != 0, F.create_map(F.lit(k), F.lit(v))).otherwise(F.create_map().cast("map<string,double>"))
    s = n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.map_concat(has(2, "face_floor", 0.45), has(3, "abs_floor", 0.5), has(5, "margin", 0.05)).alias("settings"))
    t = options.thresholds(F.col("settings"), ["face_floor", "abs_floor", "margin"])
    return s.select("n_nationkey", t.isNotNull().alias("on"), t["face_floor"].alias("face_floor"), t["margin"].alias("margin"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_INFO = f"""WITH {DET_SQL}, v AS (SELECT video_id, max(frame_idx) + 1 AS n, CASE WHEN video_id % 3 <> 0 THEN (max(frame_idx) + 1) / 24.0::DOUBLE ELSE 0 END AS own FROM det GROUP BY video_id),
 d AS (SELECT *, greatest(0, own - 2) AS taken FROM v)"""
_PICS = "pics AS (SELECT DISTINCT video_id, frame_idx, CASE WHEN frame_idx % 7 <> 0 THEN frame_idx / 24.0::DOUBLE END AS pts FROM det)"
_PATHS = """WITH p AS (SELECT 'in/' || replace(p_name, ' ', '_') || '-' || p_partkey || '.' || ['mp4', 'MOV', 'jpg', 'PNG', 'txt', 'webp', ''][p_partkey % 7 + 1] AS path, p_partkey % 7 AS r FROM part)"""
_SPECS = """WITH s AS (SELECT DISTINCT ['masks, boxes', ' blur,,faces ', 'boxes', 'tracks,halo'][n_nationkey % 4 + 1] || CASE WHEN n_nationkey % 5 = 0 THEN ', labels' ELSE '' END AS spec FROM nation),
 l AS (SELECT spec, list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') AS layers FROM s)"""

SQL = {
    "q_s3_video_info": f"{_INFO} SELECT video_id, 5.0::DOUBLE AS out_fps, round(CASE WHEN taken > 0 THEN taken ELSE own END, 6) AS duration, CASE WHEN taken > 0 THEN CAST(round_even(taken * 5, 0) AS BIGINT) ELSE n END AS n_frames FROM d",
    "q_s2_decoded_frames": f"WITH {DET_SQL}, {_PICS} SELECT video_id, frame_idx, round(pts, 6) AS pts FROM pics WHERE pts >= 2 AND pts < 20",
    "q_s1_open_video": f"""WITH RECURSIVE {DET_SQL}, {_PICS}, r AS (SELECT * FROM pics WHERE pts >= 2 AND pts < 20),
 o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts) AS i FROM r),
 w AS (SELECT video_id, frame_idx, i, TRUE AS taken, 2.5::DOUBLE AS due FROM o WHERE i = 1
   UNION ALL SELECT o.video_id, o.frame_idx, o.i, o.pts >= w.due, CASE WHEN o.pts >= w.due THEN w.due + 0.5::DOUBLE ELSE w.due END FROM w JOIN o ON o.video_id = w.video_id AND o.i = w.i + 1)
SELECT video_id, frame_idx FROM w WHERE taken""",
    "q_s7_video_inputs": f"{_PATHS} SELECT path FROM p WHERE r IN (0, 1)",
    "q_s7_rejected_inputs": f"{_PATHS} SELECT path FROM p WHERE r IN (2, 3, 5)",
    "q_s8_images": f"{_PATHS} SELECT path FROM p WHERE r IN (2, 3, 5)",
    "q_s16_references": "SELECT CAST(s_nationkey AS BIGINT) AS gid, min(s_name) AS path FROM supplier GROUP BY s_nationkey",
    "q_k3_track_cache": f"""WITH {DET_SQL} SELECT video_id, frame_idx, obj_id, gid, x1, y2, CASE WHEN k % 4 <> 0 THEN (x1 * 1000 + y1) || ',' || (y2 - y1) || ',' || (2000000 - x1 * 1000 - y2) END AS mask,
 CASE WHEN k % 3 = 0 THEN round(x1 / 2.0::DOUBLE, 6) END AS joint, CASE WHEN k % 8 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'face' ELSE 'body' END END AS path,
 CASE WHEN k % 8 <> 0 AND k % 5 <> 0 THEN round(score / 2, 6) END AS second_sim, CASE WHEN k % 8 <> 0 THEN k % 10 = 0 END AS operator FROM mat""",
    "q_s11_cache_meta": f"WITH {DET_SQL} SELECT video_id, frame_idx, obj_id, gid, k % 4 <> 0 AS has_mask FROM mat",
    "q_s10_cache_frames": f"WITH {DET_SQL} SELECT DISTINCT video_id, frame_idx, lpad(CAST(frame_idx AS VARCHAR), 6, '0') || '.npz' AS name FROM mat",
    "q_s12_cached_range": f"WITH {DET_SQL} SELECT video_id, frame_idx, obj_id, CASE WHEN k % 4 <> 0 THEN y2 - y1 END AS area FROM mat WHERE video_id < 5 AND frame_idx BETWEEN 100 AND 199",
    "q_s4_seek": f"""WITH {DET_SQL}, {_PICS}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS place FROM pics)
SELECT video_id, place AS frame_idx, 6::INT AS height, 9::INT AS width, CAST(sum((video_id * 31 + frame_idx * 7 + x * 5 + y * 11 + c * 17) % 256) AS BIGINT) AS brightness FROM o, range(9) a(x), range(6) b(y), range(3) d(c) WHERE place = 100 GROUP BY video_id, place""",
    "q_f32_meta_json": f"WITH {DET_SQL} SELECT video_id, frame_idx, obj_id, CASE WHEN k % 8 <> 0 THEN 'assignment' END AS tag, CASE WHEN k % 8 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'face' ELSE 'body' END END AS path, TRUE AS other_is_null FROM mat",
    "q_k4_frame_store": f"WITH {DET_SQL}, {_PICS} SELECT video_id, count(*) AS n_frames, count(*) - 1 AS last_idx, TRUE AS complete FROM pics GROUP BY video_id",
    "q_s13_frame_clamp": f"""WITH {DET_SQL}, {_PICS}, n AS (SELECT video_id, count(*) AS n_frames FROM pics GROUP BY video_id)
SELECT CAST(n_nationkey % 12 AS BIGINT) AS video_id, CAST(n_nationkey * 7 AS BIGINT) AS frame_idx, CAST(least(n_nationkey * 7, n_frames - 1) AS BIGINT) AS stored_idx FROM nation JOIN n ON video_id = n_nationkey % 12""",
    "q_s17_centroid_cache": f"WITH {bridge.GALLERY_SQL} SELECT gid, gid % 3 <> 0 AS hit, CASE WHEN gid % 3 <> 0 THEN round(centroid[1], 6) END AS first FROM cen",
    "q_p21_target_ids": f"""WITH {DET_SQL}, l AS (SELECT DISTINCT video_id, CAST(unnest([3, 1, 99]) AS BIGINT) AS gid FROM mat WHERE video_id % 2 = 0)
SELECT video_id, gid FROM l UNION ALL SELECT DISTINCT video_id, gid FROM mat WHERE score >= 0.97 AND video_id % 2 <> 0""",
    "q_f29_prompts": """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, concat_ws(', ', CASE WHEN p_partkey % 4 <> 0 THEN lower(p_brand) END, lower(p_type), CASE WHEN p_size > 25 THEN 'tall' END) AS prompt FROM part""",
    "q_f30_figures": f"{_SPECS} SELECT spec, array_to_string(layers, ',') AS layers, array_to_string(layers, '_') AS figure FROM l",
    "q_u6_unknown_layers": f"{_SPECS} SELECT spec, layer FROM (SELECT DISTINCT spec, unnest(layers) AS layer FROM l) WHERE layer NOT IN ('masks', 'boxes', 'tracks', 'labels', 'faces', 'limbs', 'joints', 'blur')",
    "q_z8_gate_thresholds": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, o AS on, CASE WHEN o THEN 0.45::DOUBLE END AS face_floor, CASE WHEN o THEN 0.05::DOUBLE END AS margin
FROM (SELECT *, n_nationkey % 2 <> 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 0 AS o FROM nation)""",
}
