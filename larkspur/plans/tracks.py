"""Queries on tracks, identities and their bookkeeping, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import checks, gates, sequence
from ..sources import bridge
from ..sources.bridge import DET_SQL

KEY = ["video_id", "frame_idx"]


def q_p7_mask_quality(spark, sf_dir):
    q = gates.mask_quality(F.when(F.col("k") % 11 != 0, F.col("mask_area")), geom.area(geom.box()), F.col("score"), F.col("mask_source"))
    return bridge.detections(spark, sf_dir).withColumn("q", q).select("event_id", "q.kind", F.round("q.value", 6).alias("value"), "q.floor")


def q_p22_confirmed_ids(spark, sf_dir):
    """Identities of a video with at least one detection that passes its gate, or that an operator has set."""
    ok = (F.col("score") >= 0.97) | (F.col("event_id") % 500 == 0)
    return bridge.matched(spark, sf_dir).groupBy("video_id", "gid").agg(F.bool_or(ok).alias("ok"), F.count(F.lit(1)).alias("n")).where("ok").select("video_id", "gid", "n")


def q_j20_free_ids(spark, sf_dir):
    """Gallery identities that nobody in the video has been confirmed as."""
    m = bridge.matched(spark, sf_dir)
    taken = m.where("score >= 0.97").select("video_id", "gid").distinct()
    videos, gids = m.select("video_id").distinct(), bridge.vectors(spark, sf_dir).agg(F.array_sort(F.collect_set("label")).alias("gids"))
    every = videos.join(F.broadcast(gids)).select("video_id", F.explode("gids").alias("gid"))  # the gallery is one row
    return every.join(taken, ["video_id", "gid"], "left_anti")


def _overrides(d):
    """Every 50th detection: an operator's identity, null where the resolver is left to decide."""
    return d.where("event_id % 50 = 0").select(*KEY, "obj_id", F.when(F.col("k") % 2 == 0, F.col("vec_id") % 10).alias("set_gid"))


def q_j23_overrides(spark, sf_dir):
    """Operators' identities over those that were found. An override of an object that isn't there would end the job."""
    m = bridge.matched(spark, sf_dir)
    return checks.overridden(m.select(*KEY, "obj_id", "gid"), _overrides(m), [*KEY, "obj_id"])


def q_p25_mapping_errors(spark, sf_dir):
    """Overrides of a video that name an unknown identity or one that another object has too."""
    m = bridge.matched(spark, sf_dir).where("event_id % 50 = 0 and k % 2 = 0").select("video_id", "obj_id", (F.col("vec_id") % 13).alias("gid")).distinct()
    twice = m.groupBy("video_id", "gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("video_id", "gid", F.lit("duplicate").alias("error"))
    known = bridge.vectors(spark, sf_dir).select(F.col("label").alias("gid")).distinct()
    unknown = m.select("video_id", "gid").distinct().join(known, "gid", "left_anti").select("video_id", "gid", F.lit("unknown").alias("error"))
    return twice.unionByName(unknown)


def q_a17_last_seen(spark, sf_dir):
    """Objects that a chunk of 25 frames hands on: those on its latest frame."""
    d = bridge.detections(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("frame_idx") / 25))
    last = d.groupBy("video_id", "chunk_id").agg(F.max("frame_idx").alias("frame_idx"))
    return d.join(last, ["video_id", "chunk_id", "frame_idx"], "left_semi").select("video_id", "chunk_id", "obj_id", "frame_idx")


def q_u2_absent_objects(spark, sf_dir):
    """Objects of a chunk of 25 frames that the next chunk lacks."""
    o = bridge.detections(spark, sf_dir).select("video_id", "obj_id", F.floor(F.col("frame_idx") / 25).alias("chunk_id")).distinct()
    return o.join(o.select("video_id", "obj_id", (F.col("chunk_id") - 1).alias("chunk_id")), ["video_id", "obj_id", "chunk_id"], "left_anti")


def q_k7_pending_windows(spark, sf_dir):
    """Planned windows that are not done yet; every third is."""
    plan = sequence.planned(sequence.segmented(bridge.detections(spark, sf_dir), ["video_id", "obj_id"], 48), ["video_id", "obj_id"])
    done = plan.where("(video_id + obj_id + window_idx) % 3 = 0").select("video_id", "obj_id", "segment", "window_idx")
    return plan.join(done, ["video_id", "obj_id", "segment", "window_idx"], "left_anti")


def q_s9_gallery_ids(spark, sf_dir):
    """Identities numbered from 0 by folder name. One row per identity meets in one task, never detections."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"))
    return names.select("name", (F.dense_rank().over(Window.orderBy("name")) - 1).cast("long").alias("gid"))


def q_s9_checked_gallery(spark, sf_dir):
    """Identities that customers stand for, each with its images and their faces. One without would end the job."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("folder"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(names), "c_nationkey")  # 25 nations
    faces = c.select(F.col("c_name").alias("path"), F.explode(F.sequence(F.lit(1), F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(1))))
    return checks.gallery(c.select("folder"), c.select("folder", F.col("c_name").alias("path")), faces)


def q_s15_prompts(spark, sf_dir):
    names = q_s9_gallery_ids(spark, sf_dir)
    prompts = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("gid"), F.when(F.col("r_regionkey") != 1, F.concat(F.lit(" "), "r_name")).alias("prompt"))
    return names.join(prompts, "gid", "left").select("gid", F.coalesce(F.nullif(F.trim("prompt"), F.lit("")), F.lit("a person")).alias("prompt"))


def q_f28_captions(spark, sf_dir):
    m = bridge.matched(spark, sf_dir)
    return m.select("event_id", F.concat_ws(" ", F.concat(F.lit("#"), F.col("obj_id")), F.when(F.col("gid") > 0, F.concat(F.lit("id"), F.lpad(F.col("gid").cast("string"), 3, "0"))), F.concat(F.col("k") + 1, F.lit("%"))).alias("caption"))


def q_f34_config_hash(spark, sf_dir):
    """A short name for each set of render options, whatever order they come in."""
    o = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.to_json(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))).alias("options"))
    return o.select("p_partkey", F.substring(F.sha1("options"), 1, 8).alias("name"))


def q_f35_content_key(spark, sf_dir):
    """A hash over the sorted lines of each folder's content: suppliers of a nation."""
    line = F.concat_ws("|", "s_name", F.col("s_suppkey").cast("string"))
    g = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").cast("long").alias("gid")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select("gid", F.sha2(F.array_join("lines", "\n"), 256).alias("content_key"))


def q_p26_visible_joints(spark, sf_dir):
    """Joints below 0.3 count as unseen; the score is the mean of all, and a body needs two of joints 5, 6, 11, 12."""
    j = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: ((F.col("k") + i * 7) % 100) / 100.0)
    kept = F.transform(j, lambda c: F.when(c >= 0.3, c).otherwise(0.0))
    d = bridge.detections(spark, sf_dir).withColumn("joints", kept)
    body = F.filter(F.array(*[F.get("joints", F.lit(i)) for i in (5, 6, 11, 12)]), lambda c: c > 0.3)
    return d.select("event_id", F.round(F.aggregate("joints", F.lit(0.0), lambda a, c: a + c) / 17, 6).alias("score"), (F.size(body) >= 2).alias("has_body"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

from .sequences import _SEG, _WIN  # noqa: E402

SQL = {
    "q_p7_mask_quality": f"""WITH {DET_SQL}, r AS (SELECT *, mask_area / ((x2 - x1) * (y2 - y1)) AS ratio FROM det),
 q AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'FailNone' WHEN mask_source = 'detection' AND score < 0.5 THEN 'FailScore' WHEN ratio < 0.2 AND NOT (mask_source = 'detection' AND score >= 0.85) THEN 'FailRatio' ELSE 'Pass' END AS kind FROM r)
SELECT event_id, kind, round(CASE kind WHEN 'FailScore' THEN score WHEN 'FailRatio' THEN ratio END, 6) AS value, CASE kind WHEN 'FailScore' THEN 0.5::DOUBLE WHEN 'FailRatio' THEN 0.2::DOUBLE END AS floor FROM q""",
    "q_p22_confirmed_ids": f"WITH {DET_SQL} SELECT video_id, gid, count(*) AS n FROM mat GROUP BY video_id, gid HAVING bool_or(score >= 0.97 OR event_id % 500 = 0)",
    "q_j20_free_ids": f"WITH {DET_SQL} SELECT DISTINCT v.video_id, CAST(e.label AS BIGINT) AS gid FROM (SELECT DISTINCT video_id FROM mat) v, embeddings e WHERE NOT EXISTS (SELECT 1 FROM mat m WHERE m.video_id = v.video_id AND m.gid = e.label AND score >= 0.97)",
    "q_j23_overrides": f"WITH {DET_SQL} SELECT video_id, frame_idx, obj_id, CASE WHEN event_id % 50 = 0 AND k % 2 = 0 THEN vec_id % 10 ELSE gid END AS gid, event_id % 50 = 0 AND k % 2 = 0 AS operator_assigned FROM mat",
    "q_p25_mapping_errors": f"""WITH {DET_SQL}, o AS (SELECT DISTINCT video_id, obj_id, vec_id % 13 AS gid FROM mat WHERE event_id % 50 = 0 AND k % 2 = 0)
SELECT video_id, gid, 'duplicate' AS error FROM o GROUP BY video_id, gid HAVING count(*) > 1 UNION ALL SELECT DISTINCT video_id, gid, 'unknown' FROM o WHERE gid NOT IN (SELECT label FROM embeddings)""",
    "q_a17_last_seen": f"WITH {DET_SQL} SELECT video_id, frame_idx // 25 AS chunk_id, obj_id, frame_idx FROM det QUALIFY frame_idx = max(frame_idx) OVER (PARTITION BY video_id, frame_idx // 25)",
    "q_u2_absent_objects": f"WITH {DET_SQL} SELECT DISTINCT video_id, obj_id, frame_idx // 25 AS chunk_id FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE b.video_id = a.video_id AND b.obj_id = a.obj_id AND b.frame_idx // 25 = a.frame_idx // 25 + 1)",
    "q_k7_pending_windows": f"WITH {DET_SQL}, {_SEG}, {_WIN} SELECT * FROM win WHERE (video_id + obj_id + window_idx) % 3 <> 0",
    "q_s9_gallery_ids": "SELECT n_name AS name, dense_rank() OVER (ORDER BY n_name) - 1 AS gid FROM nation",
    "q_s9_checked_gallery": "SELECT dense_rank() OVER (ORDER BY n_name) - 1 AS gid, n_name AS folder, count(*) AS n_images, CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_faces FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    "q_s15_prompts": "SELECT g.gid, CASE WHEN r_name IS NULL OR g.gid = 1 THEN 'a person' ELSE r_name END AS prompt FROM (SELECT dense_rank() OVER (ORDER BY n_name) - 1 AS gid FROM nation) g LEFT JOIN region ON r_regionkey = g.gid",
    "q_f28_captions": f"WITH {DET_SQL} SELECT event_id, '#' || obj_id || CASE WHEN gid > 0 THEN ' id' || lpad(CAST(gid AS VARCHAR), 3, '0') ELSE '' END || ' ' || (k + 1) || '%' AS caption FROM mat",
    "q_f34_config_hash": """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, substr(sha1('{"brand":"' || p_brand || '","size":"' || p_size || '"}'), 1, 8) AS name FROM part""",
    "q_f35_content_key": "SELECT CAST(s_nationkey AS BIGINT) AS gid, sha256(string_agg(s_name || '|' || s_suppkey, chr(10) ORDER BY s_name || '|' || s_suppkey)) AS content_key FROM supplier GROUP BY s_nationkey",
    "q_p26_visible_joints": f"""WITH {DET_SQL}, j AS (SELECT event_id, i, CAST((k + i * 7) % 100 AS DOUBLE) / 100 AS c FROM det, generate_series(0, 16) t(i))
SELECT event_id, round(sum(CASE WHEN c >= 0.3::DOUBLE THEN c ELSE 0 END) / 17, 6) AS score, count(*) FILTER (i IN (5, 6, 11, 12) AND c > 0.3::DOUBLE) >= 2 AS has_body FROM j GROUP BY event_id""",
}
