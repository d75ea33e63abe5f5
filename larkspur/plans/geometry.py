"""Queries on boxes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import gates, matching, prefix
from ..sources import bridge
from ..sources.bridge import DET_SQL, FRAME_H

KEY = ["video_id", "frame_idx"]


def q_f_box_scalars(spark, sf_dir):
    b = geom.box()
    cx, cy = geom.centre(b)
    short = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    y0, x0, y1, x1 = geom.crop_rect([c + 0.25 for c in b], 1500, 800)
    return bridge.detections(spark, sf_dir).select(
        "event_id", F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"), F.round(geom.diagonal(b), 6).alias("diag"), geom.area(b).cast("long").alias("area"),
        geom.round16(F.col("x2") - F.col("x1")).alias("w16"), geom.window_length(F.col("k") + 1).cast("long").alias("len4n1"), geom.odd_kernel(F.col("y2") - F.col("y1")).alias("kernel"),
        geom.share_of(short, 5, 0.025).alias("dilate"), geom.share_of(short, 5, 0.020).alias("feather"), y0.alias("crop_y0"), x0.alias("crop_x0"), y1.alias("crop_y1"), x1.alias("crop_x1"),
        geom.track_id(F.floor(F.col("frame_idx") / 21), F.col("obj_id")).cast("long").alias("track_id"),
        F.round(geom.face_quality(F.col("score"), F.col("mask_area") / 8, geom.area(b)), 6).alias("face_quality"), F.round(geom.spatial_cost(F.col("k") * 5.0), 6).alias("spatial_cost"),
    )


def q_f13_body_boxes(spark, sf_dir):
    face = [F.when(F.col("k") % 10 != 9, c) for c in (F.col("x1") + 10.5, F.col("y1") + 5.25, F.col("x1") + 40.5, F.col("y1") + 45.0 + F.col("k"))]
    return bridge.detections(spark, sf_dir).select("event_id", *[c.alias(n) for c, n in zip(geom.body_from_face(face, 1500, 800), ("bx1", "by1", "bx2", "by2"), strict=True)])


def q_j5_iou_pairs(spark, sf_dir):
    pairs = matching.overlapping_pairs(bridge.detections(spark, sf_dir), KEY, "obj_id")
    return pairs.select(*KEY, F.col("a").alias("obj_a"), F.col("b").alias("obj_b"), F.round("iou", 6).alias("iou"))


def q_j10_faces_in_persons(spark, sf_dir):
    """Faces are shrunken boxes of detections with an even k; the widest inside a person's box is the person's."""
    det = bridge.detections(spark, sf_dir)
    faces = det.where("k % 2 = 0").select(*KEY, "obj_id", F.col("x1").alias("x1"), F.col("y1").alias("y1"), (F.col("x1") + 20 + F.col("k") / 4).alias("x2"), (F.col("y1") + 40).alias("y2"))
    found = matching.faces_of(det, faces, KEY, "obj_id")
    return found.select(*KEY, "obj_id", F.col("face").cast("long").alias("face_obj"), F.round("face_width", 3).alias("face_width"))


def q_p18_mask_sanity(spark, sf_dir):
    """Blocked if another box of the frame overlaps by more than 0.2, else if the centre jumped over 15 % of the frame height."""
    det = bridge.detections(spark, sf_dir)
    pairs = matching.overlapping_pairs(det, KEY, "obj_id").where("iou > 0.2")
    crowded = pairs.select(*KEY, F.explode(F.array("a", "b")).alias("obj_id")).distinct().withColumn("crowded", F.lit(True))
    w = Window.partitionBy("video_id", "obj_id").orderBy("frame_idx")
    moved = det.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("x1", "y1", "x2", "y2")})
    jump = geom.centre_distance(geom.box(), geom.box("p_")) > 0.15 * FRAME_H
    reason = F.when(F.col("crowded"), "iou_overlap").when(jump, "bbox_jump")
    return moved.join(crowded, [*KEY, "obj_id"], "left").select(*KEY, "obj_id", reason.alias("reason"))


def q_p13_locality(spark, sf_dir):
    """Whether each identity may be where it is, given where it was seen last."""
    d = bridge.matched(spark, sf_dir)
    one = d.groupBy("video_id", "gid", "frame_idx").agg(F.min(F.struct("obj_id", "x1", "y1", "x2", "y2", "k")).alias("d")).select("video_id", "gid", "frame_idx", "d.*")
    place = ("x1", "y1", "x2", "y2", "frame_idx")
    seen = prefix.last_value(one, ["video_id", "gid"], "frame_idx", F.struct(*place), "last").select("*", *[F.col(f"last.{c}").alias(f"p_{c}") for c in place])
    gap, dist = F.col("frame_idx") - F.col("p_frame_idx"), geom.centre_distance(geom.box(), geom.box("p_"))
    path = F.when(F.col("k") % 2 == 0, "face").otherwise("osnet")
    return seen.select("video_id", "gid", "frame_idx", gap.alias("gap"), F.round(dist, 3).alias("distance"), gates.locality_ok(gap, dist, path).alias("ok"))


def q_t4_depth_order(spark, sf_dir):
    """Compositing order of a frame: by the lowest masked row, then object."""
    d = bridge.detections(spark, sf_dir)
    bottom = F.floor(F.col("y1") + (F.col("y2") - F.col("y1")) * (F.col("k") % 4 + 1) / 4.0)
    return d.select(*KEY, "obj_id", bottom.alias("bottom")).withColumn("z", (F.row_number().over(Window.partitionBy(*KEY).orderBy("bottom", "obj_id")) - 1).cast("long"))


def q_t3_best_detection(spark, sf_dir):
    d = bridge.detections(spark, sf_dir)
    best = d.groupBy(*KEY).agg(F.max(F.struct("score", (-F.col("obj_id")).alias("neg"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.select(*KEY, (-F.col("b.neg")).alias("obj_id"), F.col("b.score").alias("score"), "n")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_IOU = """ pr AS (SELECT a.video_id, a.frame_idx, a.obj_id AS obj_a, b.obj_id AS obj_b, CAST((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) AS i,
   (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.obj_id < b.obj_id
   WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1))"""

SQL = {
    "q_f_box_scalars": f"""WITH {DET_SQL}, d AS (SELECT *, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h FROM det),
 s AS (SELECT *, least(w, h) AS sh, greatest(51, CAST(round_even(h * 0.20, 0) AS BIGINT)) AS kr FROM d)
SELECT event_id, round((x1 + x2) / 2.0::DOUBLE, 3) AS cx, round((y1 + y2) / 2.0::DOUBLE, 3) AS cy, round(sqrt(w * w + h * h), 6) AS diag, (x2 - x1) * (y2 - y1) AS area,
 greatest(16, CAST(round_even(w / 16, 0) AS BIGINT) * 16) AS w16, greatest(1, (k // 4) * 4 + 1) AS len4n1, kr + CASE WHEN kr % 2 = 0 THEN 1 ELSE 0 END AS kernel,
 greatest(5, CAST(round_even(sh * 0.025, 0) AS BIGINT)) AS dilate, greatest(5, CAST(round_even(sh * 0.020, 0) AS BIGINT)) AS feather,
 least(800, y1) AS crop_y0, least(1500, x1) AS crop_x0, least(800, y2 + 1) AS crop_y1, least(1500, x2 + 1) AS crop_x1, (frame_idx // 21) * 100000 + obj_id AS track_id,
 round(score * sqrt(least(1.0::DOUBLE, (mask_area / 8) / (w * h))), 6) AS face_quality, round(1 - greatest(0.0::DOUBLE, 1 - k * 5.0::DOUBLE / 300), 6) AS spatial_cost FROM s""",
    "q_f13_body_boxes": f"""WITH {DET_SQL}, f AS (SELECT event_id, k, x1 + 10.5::DOUBLE AS a, y1 + 5.25::DOUBLE AS b, x1 + 40.5::DOUBLE AS c, CAST(y1 + 45 + k AS DOUBLE) AS d FROM det),
 r AS (SELECT *, (a + c) / 2 AS m, greatest(1.0::DOUBLE, c - a) AS w, greatest(1.0::DOUBLE, d - b) AS h FROM f)
SELECT event_id, CASE WHEN k % 10 = 9 THEN 0 ELSE greatest(0, least(1500, CAST(round_even(m - w * 1.5, 0) AS BIGINT))) END AS bx1, CASE WHEN k % 10 = 9 THEN 0 ELSE greatest(0, least(800, CAST(round_even(b - h * 0.2, 0) AS BIGINT))) END AS by1,
 CASE WHEN k % 10 = 9 THEN 1500 ELSE greatest(0, least(1500, CAST(round_even(m + w * 1.5, 0) AS BIGINT))) END AS bx2, CASE WHEN k % 10 = 9 THEN 800 ELSE greatest(0, least(800, CAST(round_even(b + h * 7.5, 0) AS BIGINT))) END AS by2 FROM r""",
    "q_j5_iou_pairs": f"WITH {DET_SQL}, {_IOU} SELECT video_id, frame_idx, obj_a, obj_b, round(i / (s - i), 6) AS iou FROM pr",
    "q_j10_faces_in_persons": f"""WITH {DET_SQL}, f AS (SELECT video_id, frame_idx, obj_id AS face_obj, (x1 + x1 + 20 + CAST(k AS DOUBLE) / 4) / 2 AS px, y1 + 20.0::DOUBLE AS py, 20 + CAST(k AS DOUBLE) / 4 AS fw FROM det WHERE k % 2 = 0),
 j AS (SELECT p.video_id, p.frame_idx, p.obj_id, f.face_obj, f.fw FROM det p LEFT JOIN f ON p.video_id = f.video_id AND p.frame_idx = f.frame_idx AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2
   QUALIFY row_number() OVER (PARTITION BY p.video_id, p.frame_idx, p.obj_id ORDER BY fw DESC NULLS LAST, face_obj) = 1)
SELECT video_id, frame_idx, obj_id, face_obj, round(fw, 3) AS face_width FROM j""",
    "q_p18_mask_sanity": f"""WITH {DET_SQL}, {_IOU}, c AS (SELECT video_id, frame_idx, unnest([obj_a, obj_b]) AS obj_id FROM pr WHERE i / (s - i) > 0.2), u AS (SELECT DISTINCT * FROM c),
 m AS (SELECT *, lag(x1) OVER o AS p1, lag(y1) OVER o AS p2, lag(x2) OVER o AS p3, lag(y2) OVER o AS p4 FROM det WINDOW o AS (PARTITION BY video_id, obj_id ORDER BY frame_idx))
SELECT m.video_id, m.frame_idx, m.obj_id, CASE WHEN u.obj_id IS NOT NULL THEN 'iou_overlap' WHEN sqrt(pow((x1 + x2 - p1 - p3) / 2.0::DOUBLE, 2) + pow((y1 + y2 - p2 - p4) / 2.0::DOUBLE, 2)) > {0.15 * FRAME_H} THEN 'bbox_jump' END AS reason
FROM m LEFT JOIN u ON m.video_id = u.video_id AND m.frame_idx = u.frame_idx AND m.obj_id = u.obj_id""",
    "q_p13_locality": f"""WITH {DET_SQL}, o1 AS (SELECT * FROM mat QUALIFY row_number() OVER (PARTITION BY video_id, gid, frame_idx ORDER BY obj_id) = 1),
 l AS (SELECT *, frame_idx - lag(frame_idx) OVER o AS gap, sqrt(pow((x1 + x2 - lag(x1) OVER o - lag(x2) OVER o) / 2.0::DOUBLE, 2) + pow((y1 + y2 - lag(y1) OVER o - lag(y2) OVER o) / 2.0::DOUBLE, 2)) AS dist
   FROM o1 WINDOW o AS (PARTITION BY video_id, gid ORDER BY frame_idx))
SELECT video_id, gid, frame_idx, gap, round(dist, 3) AS distance, CASE WHEN gap IS NULL THEN true WHEN gap > 5 THEN NOT (k % 2 <> 0 AND dist > 300 AND dist / greatest(1, gap) > 100) ELSE dist <= 300 END AS ok FROM l""",
    "q_t4_depth_order": f"""WITH {DET_SQL}, b AS (SELECT video_id, frame_idx, obj_id, CAST(floor(y1 + CAST((y2 - y1) * (k % 4 + 1) AS DOUBLE) / 4) AS BIGINT) AS bottom FROM det)
SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY bottom, obj_id) - 1 AS z FROM b""",
    "q_t3_best_detection": f"""WITH {DET_SQL} SELECT video_id, frame_idx, obj_id, score, count(*) OVER (PARTITION BY video_id, frame_idx) AS n FROM det
QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY score DESC, obj_id) = 1""",
}
