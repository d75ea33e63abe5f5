"""Queries on ordered sequences, with their SQL. Objects of a video are the sequences; max_bridge is 48 frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import gates, prefix, sequence
from ..sources import bridge
from ..sources.bridge import DET_SQL

OBJ, BRIDGE = ["video_id", "obj_id"], 48


def _by_object():
    return Window.partitionBy(*OBJ).orderBy("frame_idx")


def _frames(spark, sf_dir):
    return bridge.detections(spark, sf_dir).groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))


def q_w1_chunks(spark, sf_dir):
    m = sequence.chunk_members(_frames(spark, sf_dir), "video_id")
    return m.groupBy("video_id", "chunk_id").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count(F.lit(1)).alias("n"))


def q_p5_overlap_dedup(spark, sf_dir):
    m = sequence.first_chunk_only(sequence.chunk_members(_frames(spark, sf_dir), "video_id"), "video_id")
    return m.select("video_id", "frame_idx", "chunk_id")


def _segments(spark, sf_dir):
    return sequence.segmented(bridge.detections(spark, sf_dir), OBJ, BRIDGE)


def q_w2_segments(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy(*OBJ, "segment").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count(F.lit(1)).alias("n"))


def q_w3_windows(spark, sf_dir):
    return sequence.planned(_segments(spark, sf_dir), OBJ)


def q_w4_crop_boxes(spark, sf_dir):
    s = _segments(spark, sf_dir)
    boxes = sequence.crop_boxes(sequence.window_rows(s, sequence.planned(s, OBJ), OBJ), [*OBJ, "segment", "window_idx"])
    return boxes.select(*OBJ, "segment", "window_idx", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], "w", "h")


def q_a20_windows_per_object(spark, sf_dir):
    plan = sequence.planned(_segments(spark, sf_dir), OBJ)
    return plan.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("n_frames"))


def q_w13_cross_fade(spark, sf_dir):
    """The weight of the later window at each position that two windows own."""
    p = sequence.planned(_segments(spark, sf_dir), OBJ)
    w = Window.partitionBy(*OBJ, "segment").orderBy("window_idx")
    pairs = p.withColumns({"next_start": F.lead("start_pos").over(w)}).where("next_start <= end_pos")
    f = pairs.select(*OBJ, "segment", "window_idx", "next_start", "end_pos", F.explode(F.sequence("next_start", "end_pos")).alias("pos"))
    return f.select(*OBJ, "segment", "window_idx", "pos", F.round((F.col("pos") - F.col("next_start")) / F.greatest(F.lit(1), F.col("end_pos") - F.col("next_start")), 6).alias("alpha"))


def q_w5_carry_forward(spark, sf_dir):
    """Ghost rows of frames of a video where nothing was detected, within runs of 25 frames."""
    d = bridge.detections(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("frame_idx") / 25))
    ghosts = sequence.carried_forward(d, ["video_id", "chunk_id"], ["obj_id"], F.col("chunk_id") * 25 + 24)
    return ghosts.select("video_id", "frame_idx", "obj_id", "from_frame", F.round("score", 6).alias("score"))


def q_w6_carried_mask(spark, sf_dir):
    """Where each frame's paint mask comes from: its own, the last good one if the box hardly moved, or none."""
    d = bridge.detections(spark, sf_dir)
    kind = gates.mask_quality(F.col("mask_area"), geom.area(geom.box()), F.col("score"), F.col("mask_source"))["kind"]
    good = F.when(F.col("kind") == "Pass", F.struct("frame_idx", "x1", "y1", "x2", "y2"))
    state = prefix.last_value(d.withColumn("kind", kind), OBJ, "frame_idx", good, "last")
    last = [F.col(f"last.{c}") for c in ("x1", "y1", "x2", "y2")]
    near = gates.within_motion(geom.centre_distance(geom.box(), last), geom.diagonal(last))
    carried = (F.col("kind") != "Pass") & near
    return state.select(*OBJ, "frame_idx", "kind", F.when(F.col("kind") == "Pass", F.col("frame_idx")).when(carried, F.col("last.frame_idx")).alias("mask_frame"))


def q_w7_low_score_streak(spark, sf_dir):
    s = prefix.streak(bridge.detections(spark, sf_dir), OBJ, "frame_idx", F.col("score") < 0.4, "streak")
    return s.select(*OBJ, "frame_idx", "streak", (F.col("streak") >= 5).alias("demote"))


def q_w10_identity_changes(spark, sf_dir):
    d = bridge.matched(spark, sf_dir).select(*OBJ, "frame_idx", "gid")
    prev = F.lag("gid").over(_by_object())
    return d.select(*OBJ, "frame_idx", "gid", prev.alias("gid_prev"), F.coalesce(prev != F.col("gid"), F.lit(False)).alias("gid_changed"), (F.col("frame_idx") - F.first("frame_idx").over(_by_object())).alias("track_age"))


def q_p3_downsample(spark, sf_dir):
    d = bridge.detections(spark, sf_dir).select(*OBJ, "frame_idx", F.col("frame_idx").cast("double").alias("ts"))
    return sequence.sampled(d, OBJ, "ts", 7.5).select(*OBJ, "frame_idx")


def q_p4_time_range(spark, sf_dir):
    return bridge.detections(spark, sf_dir).where("frame_idx >= 100 and frame_idx < 200").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


def q_p10_cadence(spark, sf_dir):
    n = F.row_number().over(_by_object()) - 1
    return bridge.detections(spark, sf_dir).withColumn("seen", n.cast("long")).where("seen % 2 = 0").select(*OBJ, "frame_idx", "seen")


def q_p28_face_recent(spark, sf_dir):
    """Whether a sample with k of 70 or more came within the last 6 frames."""
    d = prefix.last_value(bridge.detections(spark, sf_dir), OBJ, "frame_idx", F.when(F.col("k") >= 70, F.col("frame_idx")), "last", own=True)
    return d.select(*OBJ, "frame_idx", "last", F.coalesce(F.col("frame_idx") - F.col("last") <= 6, F.lit(False)).alias("recent"))


def q_w17_frame_ranges(spark, sf_dir):
    """Contiguous ranges of ceil(n / 4) frames for compositing."""
    d = bridge.detections(spark, sf_dir).select("video_id", "frame_idx").distinct()
    n = _frames(spark, sf_dir)
    return d.join(n, "video_id").select("video_id", "frame_idx", F.floor(F.col("frame_idx") / F.ceil(F.col("n") / 4)).alias("part"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_N = " fr AS (SELECT video_id, max(frame_idx) + 1 AS n FROM det GROUP BY video_id)"
_CH = f"""{_N}, ch AS (SELECT video_id, n, unnest(generate_series(0, (n - 1) // 21)) AS chunk_id FROM fr), ck AS (SELECT * FROM ch WHERE chunk_id = 0 OR n - chunk_id * 21 > 4)"""
_SEG = f""" g0 AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id, obj_id ORDER BY frame_idx) > {1 + BRIDGE} THEN 1 ELSE 0 END AS nw FROM det),
 g1 AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY video_id, obj_id ORDER BY frame_idx) AS BIGINT) AS segment FROM g0),
 seg AS (SELECT *, row_number() OVER (PARTITION BY video_id, obj_id, segment ORDER BY frame_idx) - 1 AS pos FROM g1)"""
_K = "video_id, obj_id, segment"
_WIN = f""" sz AS (SELECT {_K}, count(*) AS n FROM seg GROUP BY {_K}), cd AS (SELECT *, unnest(generate_series(0, (n - 1) // 36)) AS j FROM sz),
 ce AS (SELECT *, j * 36 AS st, j * 36 + greatest(1, ((least(49, n - j * 36) - 1) // 4) * 4 + 1) - 1 AS en FROM cd),
 cf AS (SELECT *, (en - st + 1 < 5) OR coalesce(en <= lag(en) OVER o OR lag(en) OVER o >= n - 1, false) AS fail FROM ce WINDOW o AS (PARTITION BY {_K} ORDER BY j)),
 cg AS (SELECT *, min(CASE WHEN fail THEN j END) OVER (PARTITION BY {_K}) AS ff FROM cf), ci AS (SELECT * FROM cg WHERE ff IS NULL OR j < ff),
 cl AS (SELECT *, lead(j) OVER o IS NULL AS is_last, coalesce(lag(en, 2) OVER o, -1) AS pe FROM ci WINDOW o AS (PARTITION BY {_K} ORDER BY j)),
 win AS (SELECT {_K}, j AS window_idx, CASE WHEN is_last AND en < n - 1 AND n - 1 - (en - st) > pe THEN n - 1 - (en - st) ELSE st END AS start_pos,
   CASE WHEN is_last AND en < n - 1 AND n - 1 - (en - st) > pe THEN n - 1 ELSE en END AS end_pos FROM cl)"""
_O = "(PARTITION BY video_id, obj_id ORDER BY frame_idx)"

SQL = {
    "q_w1_chunks": f"WITH {DET_SQL}, {_CH} SELECT video_id, chunk_id, chunk_id * 21 AS first_frame, least(n - 1, chunk_id * 21 + 24) AS last_frame, least(n - 1, chunk_id * 21 + 24) - chunk_id * 21 + 1 AS n FROM ck",
    "q_p5_overlap_dedup": f"""WITH {DET_SQL}, {_CH}, m AS (SELECT video_id, chunk_id, unnest(generate_series(chunk_id * 21, least(n - 1, chunk_id * 21 + 24))) AS frame_idx FROM ck)
SELECT video_id, frame_idx, min(chunk_id) AS chunk_id FROM m GROUP BY video_id, frame_idx""",
    "q_w2_segments": f"WITH {DET_SQL}, {_SEG} SELECT {_K}, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n FROM seg GROUP BY {_K}",
    "q_w3_windows": f"WITH {DET_SQL}, {_SEG}, {_WIN} SELECT * FROM win",
    "q_w4_crop_boxes": f"""WITH {DET_SQL}, {_SEG}, {_WIN}, u AS (SELECT w.video_id, w.obj_id, w.segment, w.window_idx, CAST(min(x1) AS DOUBLE) AS a, CAST(min(y1) AS DOUBLE) AS b, CAST(max(x2) AS DOUBLE) AS c, CAST(max(y2) AS DOUBLE) AS d
   FROM win w JOIN seg s ON w.video_id = s.video_id AND w.obj_id = s.obj_id AND w.segment = s.segment AND pos BETWEEN start_pos AND end_pos GROUP BY ALL),
 p AS (SELECT *, a - (c - a) * 0.1::DOUBLE AS x0, b - (d - b) * 0.1::DOUBLE AS y0, c + (c - a) * 0.1::DOUBLE AS x1, d + (d - b) * 0.1::DOUBLE AS y1 FROM u)
SELECT {_K}, window_idx, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, greatest(16, CAST(round_even((x1 - x0) / greatest(1.0::DOUBLE, y1 - y0) * 832 / 16, 0) AS BIGINT) * 16) AS w, CAST(832 AS BIGINT) AS h FROM p""",
    "q_a20_windows_per_object": f"WITH {DET_SQL}, {_SEG}, {_WIN} SELECT video_id, obj_id, count(*) AS n_windows, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS n_frames FROM win GROUP BY video_id, obj_id",
    "q_w13_cross_fade": f"""WITH {DET_SQL}, {_SEG}, {_WIN}, n AS (SELECT *, lead(start_pos) OVER (PARTITION BY {_K} ORDER BY window_idx) AS ns FROM win),
 f AS (SELECT *, unnest(generate_series(ns, end_pos)) AS pos FROM n WHERE ns <= end_pos)
SELECT {_K}, window_idx, pos, round(CAST(pos - ns AS DOUBLE) / greatest(1, end_pos - ns), 6) AS alpha FROM f""",
    "q_w5_carry_forward": f"""WITH {DET_SQL}, real AS (SELECT DISTINCT video_id, frame_idx, frame_idx // 25 AS chunk_id FROM det),
 grid AS (SELECT DISTINCT video_id, chunk_id, unnest(generate_series(chunk_id * 25, chunk_id * 25 + 24)) AS frame_idx FROM real),
 g AS (SELECT grid.*, max(real.frame_idx) OVER (PARTITION BY grid.video_id, grid.chunk_id ORDER BY grid.frame_idx ROWS UNBOUNDED PRECEDING) AS from_frame, real.frame_idx IS NOT NULL AS here FROM grid LEFT JOIN real USING (video_id, chunk_id, frame_idx))
SELECT g.video_id, g.frame_idx, d.obj_id, g.from_frame, round(d.score * 0.9::DOUBLE, 6) AS score FROM g JOIN det d ON d.video_id = g.video_id AND d.frame_idx = g.from_frame WHERE NOT here AND g.frame_idx - from_frame <= 3""",
    "q_w6_carried_mask": f"""WITH {DET_SQL}, q AS (SELECT *, CASE WHEN mask_source = 'detection' AND score < 0.5 THEN 'FailScore' WHEN mask_area / ((x2 - x1) * (y2 - y1)) < 0.2 AND NOT (mask_source = 'detection' AND score >= 0.85) THEN 'FailRatio' ELSE 'Pass' END AS kind FROM det),
 l AS (SELECT *, max(CASE WHEN kind = 'Pass' THEN frame_idx END) OVER (PARTITION BY video_id, obj_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf FROM q)
SELECT l.video_id, l.obj_id, l.frame_idx, l.kind, CASE WHEN l.kind = 'Pass' THEN l.frame_idx WHEN sqrt(pow((l.x1 + l.x2 - p.x1 - p.x2) / 2.0::DOUBLE, 2) + pow((l.y1 + l.y2 - p.y1 - p.y2) / 2.0::DOUBLE, 2)) <= 0.15::DOUBLE * sqrt(CAST(pow(p.x2 - p.x1, 2) + pow(p.y2 - p.y1, 2) AS DOUBLE)) THEN lf END AS mask_frame
FROM l LEFT JOIN q p ON p.video_id = l.video_id AND p.obj_id = l.obj_id AND p.frame_idx = l.lf""",
    "q_w7_low_score_streak": f"""WITH {DET_SQL}, p AS (SELECT *, score < 0.4 AS f, sum(CASE WHEN score < 0.4 THEN 0 ELSE 1 END) OVER {_O} AS g FROM det),
 s AS (SELECT *, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, obj_id, g ORDER BY frame_idx) AS BIGINT) AS streak FROM p)
SELECT video_id, obj_id, frame_idx, streak, streak >= 5 AS demote FROM s""",
    "q_w10_identity_changes": f"WITH {DET_SQL} SELECT video_id, obj_id, frame_idx, gid, lag(gid) OVER {_O} AS gid_prev, coalesce(lag(gid) OVER {_O} <> gid, false) AS gid_changed, frame_idx - min(frame_idx) OVER (PARTITION BY video_id, obj_id) AS track_age FROM mat",
    "q_p3_downsample": f"""WITH RECURSIVE {DET_SQL}, t AS (SELECT video_id, obj_id, frame_idx, row_number() OVER {_O} AS i FROM det),
 r AS (SELECT video_id, obj_id, frame_idx, i, 7.5::DOUBLE AS nxt, true AS emit FROM t WHERE i = 1
   UNION ALL SELECT t.video_id, t.obj_id, t.frame_idx, t.i, CASE WHEN t.frame_idx >= r.nxt THEN r.nxt + 7.5 ELSE r.nxt END, t.frame_idx >= r.nxt FROM r JOIN t ON t.video_id = r.video_id AND t.obj_id = r.obj_id AND t.i = r.i + 1)
SELECT video_id, obj_id, frame_idx FROM r WHERE emit""",
    "q_p4_time_range": f"WITH {DET_SQL} SELECT video_id, count(*) AS n FROM det WHERE frame_idx >= 100 AND frame_idx < 200 GROUP BY video_id",
    "q_p10_cadence": f"WITH {DET_SQL}, s AS (SELECT video_id, obj_id, frame_idx, row_number() OVER {_O} - 1 AS seen FROM det) SELECT * FROM s WHERE seen % 2 = 0",
    "q_p28_face_recent": f"""WITH {DET_SQL}, l AS (SELECT video_id, obj_id, frame_idx, max(CASE WHEN k >= 70 THEN frame_idx END) OVER {_O} AS last FROM det)
SELECT *, coalesce(frame_idx - last <= 6, false) AS recent FROM l""",
    "q_w17_frame_ranges": f"WITH {DET_SQL}, {_N} SELECT DISTINCT video_id, frame_idx, CAST(frame_idx // CAST(ceil(n / 4.0::DOUBLE) AS BIGINT) AS BIGINT) AS part FROM det JOIN fr USING (video_id)",
}
