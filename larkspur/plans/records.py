"""Queries on proposals, telemetry and canvas geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import kalman
from ..sources import bridge, records
from ..sources.bridge import DET_SQL

CANVAS = (832, 480)


def _proposed(spark, sf_dir):
    """Matched detections; every eleventh has no identity."""
    return bridge.matched(spark, sf_dir).withColumn("gid", F.when(F.col("event_id") % 11 != 0, F.col("gid")))


def q_k14_proposals(spark, sf_dir):
    return records.proposals(_proposed(spark, sf_dir))


def q_f36_operator_ids(spark, sf_dir):
    """Identities read back from proposal texts."""
    return records.operator_ids(records.proposals(_proposed(spark, sf_dir)))


def q_m17_telemetry(spark, sf_dir):
    """One log of rows that fail the score gate and of objects whose identity changes."""
    m = bridge.matched(spark, sf_dir)
    before = F.lag("gid").over(Window.partitionBy("video_id", "obj_id").orderBy("frame_idx"))
    rebind = m.withColumn("gid_prev", before).where("gid <> gid_prev").select("video_id", "obj_id", "frame_idx", "gid", "gid_prev")
    gate = m.where("score < 0.5").select("video_id", "obj_id", "frame_idx", "gid", "score")
    return records.telemetry(gate=gate, rebind=rebind)


def q_f19_letterbox(spark, sf_dir):
    """Where a box's crop lands, centred, on a canvas of other proportions."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    placed = [c.alias(n) for n, c in zip(("x0", "y0", "w", "h"), geom.letterbox(w, h, *CANVAS), strict=True)]
    return bridge.detections(spark, sf_dir).select("event_id", *placed)


def q_f20_crop_points(spark, sf_dir):
    """The middle of a box's top edge in the pixels of its own crop, scaled to the canvas."""
    x, y = geom.to_crop((F.col("x1") + F.col("x2")) / 2.0, F.col("y1").cast("double"), geom.crop_rect(geom.box(), 1500, bridge.FRAME_H), *CANVAS)
    return bridge.detections(spark, sf_dir).select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def q_f26_duration(spark, sf_dir):
    """How long an object's track is at 25 frames a second: hours if there are any, minutes, seconds."""
    t = bridge.detections(spark, sf_dir).groupBy("video_id", "obj_id").agg(F.bround((F.max("frame_idx") - F.min("frame_idx")) / 25.0).cast("long").alias("s"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = F.floor(F.col("s") / 3600), F.floor(F.col("s") / 60) % 60, F.col("s") % 60
    text = F.when(h > 0, F.concat(h, F.lit("h"), two(m), F.lit("m"))).otherwise(F.concat(m, F.lit("m")))
    return t.select("video_id", "obj_id", F.concat(text, two(s), F.lit("s")).alias("duration"))


def q_w16_box_filter(spark, sf_dir):
    """Box tracks through the constant-velocity filter. SQL can't express it; a matrix filter tests it."""
    return kalman.filtered_boxes(bridge.detections(spark, sf_dir))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_PRO = "pro AS (SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN gid END AS gid) FROM mat)"

SQL = {
    "q_k14_proposals": f"""WITH {DET_SQL}, {_PRO},
 t AS (SELECT *, '{{"obj_id":' || obj_id || ',"bbox":[' || x1 || '.0,' || y1 || '.0,' || x2 || '.0,' || y2 || '.0],"proposed_gid":' || coalesce(gid, -1) || ',"operator_gid":' || coalesce(gid, -1) || '}}' AS o FROM pro)
SELECT video_id, frame_idx, '{{"objects":[' || string_agg(o, ',' ORDER BY obj_id) || ']}}' AS proposal FROM t GROUP BY video_id, frame_idx""",
    "q_f36_operator_ids": f"WITH {DET_SQL}, {_PRO} SELECT video_id, frame_idx, obj_id, gid FROM pro",
    "q_m17_telemetry": f"""WITH {DET_SQL}, p AS (SELECT *, lag(gid) OVER (PARTITION BY video_id, obj_id ORDER BY frame_idx) AS gid_prev FROM mat)
SELECT 'gate' AS kind, video_id, obj_id, frame_idx, gid, score, CAST(NULL AS BIGINT) AS gid_prev FROM mat WHERE score < 0.5::DOUBLE
UNION ALL SELECT 'rebind', video_id, obj_id, frame_idx, gid, NULL, gid_prev FROM p WHERE gid <> gid_prev""",
    "q_f19_letterbox": f"""WITH {DET_SQL}, s AS (SELECT event_id, x2 - x1 AS bw, y2 - y1 AS bh, least({CANVAS[0]}::DOUBLE / (x2 - x1), {CANVAS[1]}::DOUBLE / (y2 - y1)) AS f FROM det),
 r AS (SELECT event_id, CAST(round_even(bw * f, 0) AS BIGINT) AS w, CAST(round_even(bh * f, 0) AS BIGINT) AS h FROM s)
SELECT event_id, ({CANVAS[0]} - w) // 2 AS x0, ({CANVAS[1]} - h) // 2 AS y0, w, h FROM r""",
    "q_f20_crop_points": f"""WITH {DET_SQL}, c AS (SELECT *, greatest(0, least(1500, x1)) AS cx0, greatest(0, least(1500, x2)) AS cx1, greatest(0, least(1000, y1)) AS cy0, greatest(0, least(1000, y2)) AS cy1 FROM det)
SELECT event_id, round((CAST(x1 + x2 AS DOUBLE) / 2 - cx0) * ({CANVAS[0]}::DOUBLE / greatest(1, cx1 - cx0)), 6) AS x, round((y1::DOUBLE - cy0) * ({CANVAS[1]}::DOUBLE / greatest(1, cy1 - cy0)), 6) AS y FROM c""",
    "q_f26_duration": f"""WITH {DET_SQL}, t AS (SELECT video_id, obj_id, CAST(round_even(CAST(max(frame_idx) - min(frame_idx) AS DOUBLE) / 25, 0) AS BIGINT) AS s FROM det GROUP BY video_id, obj_id)
SELECT video_id, obj_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || 'm' ELSE (s // 60) || 'm' END || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' AS duration FROM t""",
}
