"""Queries on evidence, matching rules and what the resolver reports, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cost, geom, vec
from ..operators import evidence, gallery, greedy, intervals, matching, prefix, sequence
from ..sources import bridge, records
from ..sources.bridge import DET_SQL, GALLERY_SQL
from .geometry import q_p18_mask_sanity

FRAME, OBJ = ["video_id", "frame_idx"], ["video_id", "obj_id"]
BRIDGE = 48


def _by_object():
    return Window.partitionBy(*OBJ).orderBy("frame_idx")


def _faces(spark, sf_dir):
    """Up to three faces in each detection's crop."""
    one = lambda i: F.struct(((F.col("k") * 13 * i) % 90).alias("width"), ((F.col("k") * 7 + i * 31) % 100 / 100.0).cast("double").alias("score"), i.cast("long").alias("face"))
    faces = F.transform(F.filter(F.array(*[F.lit(i) for i in (1, 2, 3)]), lambda i: i <= F.col("k") % 4), one)
    return bridge.detections(spark, sf_dir).select("event_id", faces.alias("faces"))


def q_p8_best_face(spark, sf_dir):
    """The widest face of each crop if it is wide enough, and whether it is also sure enough to be a sample."""
    f = _faces(spark, sf_dir)
    return f.select("event_id", evidence.widest(F.col("faces"))["face"].alias("face"), evidence.widest(F.col("faces"), 40.0, 0.6).isNotNull().alias("sample"))


def q_p9_all_faces(spark, sf_dir):
    return _faces(spark, sf_dir).select("event_id", F.array_join(F.transform(evidence.passing(F.col("faces")), lambda f: f["face"].cast("string")), ",").alias("faces"))


def q_p11_zero_vectors(spark, sf_dir):
    """Vectors that say nothing, as a model gives for an invalid crop."""
    v = bridge.vectors(spark, sf_dir).withColumn("embedding", F.when(F.col("vec_id") % 17 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return v.where(~vec.is_zero(F.col("embedding"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))


def _sampled(spark, sf_dir):
    """Every second row of an object; those with an even k show a face."""
    n = F.row_number().over(_by_object()) - 1
    return bridge.matched(spark, sf_dir).withColumn("seen", n).where("seen % 2 = 0").withColumn("has_face", F.col("k") % 2 == 0)


def q_p12_evidence(spark, sf_dir):
    """Objects that may be confirmed: three samples of a face or of a body so far, and not confirmed yet (a score of 0.97 does that)."""
    upto = _by_object().rowsBetween(Window.unboundedPreceding, 0)
    s = _sampled(spark, sf_dir)
    s = s.withColumns({"n_face": F.count(F.when(F.col("has_face"), 1)).over(upto), "n_body": F.count(F.when(~F.col("has_face"), 1)).over(upto), "done": F.coalesce(F.bool_or(F.col("score") >= 0.97).over(upto), F.lit(False))})
    return s.where("(n_face >= 3 or n_body >= 3) and not done").select(*OBJ, "frame_idx", "n_face", "n_body")


def _with_vectors(spark, sf_dir):
    return bridge.matched(spark, sf_dir).join(bridge.vectors(spark, sf_dir).select("vec_id", "embedding"), "vec_id")


def q_p15_consistency(spark, sf_dir):
    """Faces that are unlike the weighted mean of those before them. Weights are scores; the floor suits the bridge's vectors."""
    m = _with_vectors(spark, sf_dir).where("k % 2 = 0")
    before = prefix.running_means(m, OBJ, "frame_idx", "embedding", F.col("k") + 1, before=True)
    j = m.join(before, [*OBJ, "frame_idx"])
    cos = F.round(vec.dot(vec.unit(F.col("embedding")), F.col("running")), 9)
    return j.select(*OBJ, "frame_idx", "n", evidence.inconsistent(cos, F.col("n"), F.col("score"), 0.0, 0.7).alias("reset"))


def q_a3_body_mean(spark, sf_dir):
    """The mean body of each object after each sample, all samples alike: its cosine with the first number's axis."""
    m = _with_vectors(spark, sf_dir)
    r = prefix.running_means(m, OBJ, "frame_idx", "embedding", F.lit(1))
    return r.select(*OBJ, "frame_idx", "n", F.round(F.element_at("running", 1), 6).alias("first"))


def _own_cosine(spark, sf_dir):
    """Detections with the cosine of what they show and the identity they are matched with, an operator's mark and a streak."""
    sims = gallery.similarities(bridge.vectors(spark, sf_dir), bridge.gallery(spark, sf_dir), "embedding", ["vec_id", "label"])
    own = sims.where("gid = label").select("vec_id", F.round("cos", 9).alias("cos"))
    m = bridge.matched(spark, sf_dir).join(own, "vec_id")
    sane = q_p18_mask_sanity(spark, sf_dir).withColumnRenamed("reason", "insane")
    return m.join(sane, [*FRAME, "obj_id"]).withColumns({"operator": F.col("k") % 10 == 0, "low": F.when(F.col("k") % 6 == 0, 1).otherwise(0), "lost": F.when(F.col("k") % 8 == 1, 1).otherwise(0)})


def _gid():
    return F.when(F.col("k") % 9 != 0, F.col("gid")).otherwise(F.lit(-1).cast("long"))


def _face_reason():
    return evidence.face_write(_gid(), F.col("score"), F.col("cos"), F.col("operator"), F.col("low"), F.col("insane"), 0.6, 0.1)


def q_p16_face_writes(spark, sf_dir):
    """Faces that may enter their identity's pool, and why others may not. The cosine floor suits the bridge's vectors."""
    return _own_cosine(spark, sf_dir).select(*OBJ, "frame_idx", _face_reason().alias("refused"))


def q_j19_last_face(spark, sf_dir):
    """The last frame at which an object's face was admitted, as of each frame, if it is at most 30 frames ago."""
    admitted = F.when(_face_reason().isNull(), F.col("frame_idx"))
    d = prefix.last_value(_own_cosine(spark, sf_dir), OBJ, "frame_idx", admitted, "last_face", own=True)
    return d.select(*OBJ, "frame_idx", F.when(F.col("frame_idx") - F.col("last_face") <= 30, F.col("last_face")).alias("last_face"))


def q_p17_body_writes(spark, sf_dir):
    d = _own_cosine(spark, sf_dir).join(q_j19_last_face(spark, sf_dir), [*OBJ, "frame_idx"])
    since = F.col("frame_idx") - F.col("last_face")
    return d.select(*OBJ, "frame_idx", evidence.body_write(_gid(), F.col("low"), F.col("lost"), F.col("operator"), since, F.col("insane")).alias("refused"))


def _challenged(spark, sf_dir):
    sims = matching.similarities(bridge.vectors(spark, sf_dir), bridge.gallery(spark, sf_dir), "embedding").select("vec_id", F.transform("sims", lambda s: F.struct(F.round(s["cos"], 9).alias("cos"), s["gid"].alias("gid"))).alias("sims"))
    return evidence.challengers(bridge.matched(spark, sf_dir).join(sims, "vec_id").withColumn("confirmed", F.col("score") >= 0.5), FRAME)


def q_a5_challenger(spark, sf_dir):
    """The best cosine that objects nobody has confirmed have with the identity of each confirmed one in their frame."""
    return _challenged(spark, sf_dir).select(*FRAME, "obj_id", "gid", F.round("own", 6).alias("own"), F.round("challenger", 6).alias("challenger"))


def q_w8_column_loss(spark, sf_dir):
    """How many samples in a row a challenger has led by more than 0.05."""
    led = F.col("challenger") - F.col("own") > 0.05
    return prefix.streak(_challenged(spark, sf_dir), OBJ, "frame_idx", led, "streak").select(*OBJ, "frame_idx", "streak")


def _founded(spark, sf_dir):
    upto = _by_object().rowsBetween(Window.unboundedPreceding, 0)
    return bridge.matched(spark, sf_dir).withColumns({
        "operator": F.col("k") % 10 == 0, "face_weight": F.coalesce(F.sum(F.when(F.col("k") % 2 == 0, F.col("k"))).over(upto), F.lit(0)),
        "body_weight": F.count(F.when(F.col("k") % 2 == 1, 1)).over(upto), "frames_seen": F.count(F.lit(1)).over(upto),
    })


def q_a18_duplicate_holders(spark, sf_dir):
    """Objects of a frame that hold one identity: which of them stays, and who loses it."""
    return evidence.holders(_founded(spark, sf_dir), FRAME)


def q_w9_recency(spark, sf_dir):
    """What the gap since an object was seen last still allows: revival, trust in its place, trust in its body, one report of it."""
    d = bridge.detections(spark, sf_dir).withColumn("gap", F.col("frame_idx") - F.lag("frame_idx").over(_by_object()))
    return d.select(*OBJ, "frame_idx", "gap", *[F.coalesce(F.col("gap") <= n, F.lit(False)).alias(name) for name, n in (("revive", 15), ("near", 5), ("trusted", 30), ("reported", 50))])


def q_u1_live_objects(spark, sf_dir):
    return bridge.matched(spark, sf_dir).groupBy(*FRAME).agg(F.array_join(F.transform(F.array_sort(F.collect_set("obj_id")), lambda x: x.cast("string")), ",").alias("objects"), F.count_distinct("gid").alias("gids"))


def q_j2_bindings(spark, sf_dir):
    """Rows with what is known of their object from before this chunk of 25 frames; new objects have nothing."""
    m = bridge.matched(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("frame_idx") / 25))
    known = m.groupBy(*OBJ, (F.col("chunk_id") + 1).alias("chunk_id")).agg(F.max(F.struct("frame_idx", "gid")).alias("b"))
    return m.join(known, [*OBJ, "chunk_id"], "left").select(*OBJ, "frame_idx", F.col("b.gid").alias("bound"), F.col("b.frame_idx").alias("seen"))


def q_j3_keypoints(spark, sf_dir):
    """Tracks and keypoints of a frame, kept in two lists, put together by their place in them."""
    d = bridge.matched(spark, sf_dir)
    lists = d.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("obj_id", "gid"))).alias("tracks"), F.array_sort(F.collect_list(F.struct("obj_id", "x1"))).alias("points"))
    t = lists.select(*FRAME, F.posexplode("tracks").alias("pos", "t"))
    p = lists.select(*FRAME, F.posexplode("points").alias("pos", "p"))
    return t.join(p, [*FRAME, "pos"]).select(*FRAME, F.col("pos").cast("long").alias("pos"), "t.gid", F.col("p.x1").alias("point"))


def q_j11_still_ids(spark, sf_dir):
    """Persons of a still with the identity their face is most like, -1 below the floor or without a face; two may share one."""
    det = _with_vectors(spark, sf_dir)
    faces = det.where("k % 2 = 0").select(*FRAME, "obj_id", "x1", "y1", (F.col("x1") + 20 + F.col("k") / 4).alias("x2"), (F.col("y1") + 40).alias("y2"))
    found = matching.faces_of(det, faces, FRAME, "obj_id")
    top = gallery.top_two(bridge.vectors(spark, sf_dir), bridge.gallery(spark, sf_dir), "embedding", ["vec_id"]).select("vec_id", F.col("gid").alias("best"), "assigned_sim")
    shown = det.select(*FRAME, F.col("obj_id").alias("face"), "vec_id").join(top, "vec_id").select(*FRAME, "face", "best", F.round("assigned_sim", 6).alias("cos"))
    j = found.join(shown, [*FRAME, "face"], "left")
    return j.select(*FRAME, "obj_id", "cos", F.when(F.col("cos") >= 0.3, F.col("best")).otherwise(F.lit(-1).cast("long")).alias("gid"))


def q_j12_photo_person(spark, sf_dir):
    """The box to take from a gallery photo: the surest that holds the face whole, else the surest. Frames are the photos, the face that of the first object."""
    d = bridge.detections(spark, sf_dir)
    face = d.groupBy(*FRAME).agg(F.min(F.struct("obj_id", "x1", "y1")).alias("f"))
    inside = (F.col("x1") <= F.col("f.x1") + 10) & (F.col("y1") <= F.col("f.y1") + 10) & (F.col("x2") >= F.col("f.x1") + 40) & (F.col("y2") >= F.col("f.y1") + 50)
    best = d.join(face, FRAME).groupBy(*FRAME).agg(F.max(F.struct(inside.alias("inside"), "score", (-F.col("obj_id")).alias("neg"))).alias("b"))
    return best.select(*FRAME, (-F.col("b.neg")).alias("obj_id"), F.col("b.inside").alias("inside"))


def _candidates(spark, sf_dir):
    sims = gallery.similarities(bridge.vectors(spark, sf_dir), bridge.gallery(spark, sf_dir), "embedding", ["vec_id"])
    return bridge.detections(spark, sf_dir).select("event_id", "k", "vec_id").join(sims, "vec_id")


def q_j21_allowed_pairs(spark, sf_dir):
    """Objects and identities that may be paired: those that have been parted before may not."""
    c = _candidates(spark, sf_dir)
    parted = c.where("(event_id + gid) % 4 = 0").select("event_id", "gid")
    return c.select("event_id", "gid").join(parted, ["event_id", "gid"], "left_anti")


def q_j22_operator_tracks(spark, sf_dir):
    """Rows of objects to which an operator has ever given their identity."""
    m = bridge.matched(spark, sf_dir)
    return m.join(m.where("event_id % 50 = 0 and k % 2 = 0").select(*OBJ, "gid").distinct(), [*OBJ, "gid"], "left_semi").select(*OBJ, "frame_idx", "gid")


def _costs(spark, sf_dir):
    """Pairs with made-up pools: three of four have one, of up to six views."""
    c = _candidates(spark, sf_dir).withColumn("cos", F.round("cos", 9))
    s = (F.col("event_id") + F.col("gid")) % 4
    return c.withColumns({"s": s, "warm": F.when(s != 0, F.round(F.col("cos") + s * 0.2 - 0.3, 9)), "size": ((F.col("k") + F.col("gid")) % 7).cast("long")})


def q_f9_body_similarity(spark, sf_dir):
    c = _costs(spark, sf_dir)
    a, b = (cost.body_similarity(F.col("cos"), F.col("warm"), F.col("size"), only, 3, 0.2) for only in (True, False))
    return c.select("event_id", "gid", F.round(a["sim"], 6).alias("warm_sim"), a["feasible"].alias("warm_ok"), F.round(b["sim"], 6).alias("blend_sim"), b["feasible"].alias("blend_ok"), b["warm_won"].alias("warm_won"))


def q_f8_pair_costs(spark, sf_dir):
    c = _costs(spark, sf_dir)
    body = cost.body_similarity(F.col("cos"), F.col("warm"), F.col("size"), False, 3, 0.2)
    face = F.when(F.col("k") % 20 == 0, F.col("cos"))
    p = cost.pair_cost(face, F.col("warm"), body, F.when(F.col("gid") % 2 == 0, (F.col("k") / 100).cast("double")), F.col("s") == 3, 0.8, 0.2)
    return c.select("event_id", "gid", F.round(p["cost"], 6).alias("cost"), p["masked"].alias("masked"))


def q_f11_inherit_bonus(spark, sf_dir):
    c = _costs(spark, sf_dir)
    bonus = cost.inherit_bonus(F.when(F.col("s") == 1, F.col("cos")), F.when(F.col("s") >= 2, F.col("cos")))
    return c.select("event_id", "gid", F.round(bonus, 6).alias("bonus"))


def _planned(spark, sf_dir):
    return sequence.planned(sequence.segmented(bridge.detections(spark, sf_dir), OBJ, BRIDGE), OBJ)


def _in_windows(spark, sf_dir, rows="true"):
    """Rows of segments with the windows that hold their place."""
    seg = sequence.segmented(bridge.detections(spark, sf_dir), OBJ, BRIDGE)
    points = seg.where(rows).select(*OBJ, "segment", "pos")
    return intervals.points_in(points, sequence.planned(seg, OBJ), [*OBJ, "segment"], "pos", "start_pos", "end_pos")


def q_j24_window_owners(spark, sf_dir):
    """The windows that hold each position, one or two."""
    return _in_windows(spark, sf_dir).groupBy(*OBJ, "segment", "pos").agg(F.min("window_idx").alias("first"), F.max("window_idx").alias("last"), F.count(F.lit(1)).alias("n"))


def q_w14_reused_frames(spark, sf_dir):
    """How many positions of a window an earlier one has stored already, and those that are its own to paint."""
    earlier = Window.partitionBy(*OBJ, "segment").orderBy("window_idx").rowsBetween(Window.unboundedPreceding, -1)
    w = _planned(spark, sf_dir).withColumn("done", F.max("end_pos").over(earlier))
    reused = F.when(F.col("done") >= F.col("start_pos"), F.least("done", "end_pos") - F.col("start_pos") + 1).otherwise(0).cast("long")
    return w.select(*OBJ, "segment", "window_idx", reused.alias("reused"), (F.col("end_pos") - F.col("start_pos") + 1 - reused).alias("own"))


def q_j24_shared_windows(spark, sf_dir):
    """Pairs of windows of a segment that share frames, and where."""
    w = _planned(spark, sf_dir)
    a, b = (w.select(*OBJ, "segment", F.col("window_idx").alias(n), F.col("start_pos").alias(f"s_{n}"), F.col("end_pos").alias(f"e_{n}")) for n in ("a", "b"))
    met = intervals.overlapping(a, b, [*OBJ, "segment"], ("s_a", "s_b"), ("e_a", "e_b")).where("a < b")
    return met.select(*OBJ, "segment", "a", "b", F.col("from").alias("first"), F.col("to").alias("last"))


def q_u7_stored_frames(spark, sf_dir):
    """Positions of a window that are in the store, which has every third."""
    return _in_windows(spark, sf_dir, "pos % 3 = 0").groupBy(*OBJ, "segment", "window_idx").agg(F.count(F.lit(1)).alias("n"))


def q_t8_window_frames(spark, sf_dir):
    """All positions that windows of an object take, once each and in order."""
    s = _in_windows(spark, sf_dir).groupBy(*OBJ, "segment").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    return s.select(*OBJ, "segment", F.md5(F.array_join(F.col("p").cast("array<string>"), ",")).alias("positions"), F.size("p").cast("long").alias("n"))


def _changed(spark, sf_dir):
    """(video_id, frame_idx, new or gone objects with their boxes): those that a frame shows and the one before doesn't, and the other way round."""
    d = bridge.detections(spark, sf_dir).select(*FRAME, "obj_id", "x1", "y1", "x2", "y2")
    back, on = d.withColumn("frame_idx", F.col("frame_idx") - 1), d.withColumn("frame_idx", F.col("frame_idx") + 1)
    key = [*FRAME, "obj_id"]
    return d.join(on, key, "left_anti"), d.join(back, key, "left_anti").withColumn("frame_idx", F.col("frame_idx") + 1)


_NONE = np.iinfo(np.int64).min
_BOX = ["x1", "y1", "x2", "y2"]


def _met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Width and height of what boxes of a and of b share, for all pairs."""
    return tuple(np.minimum(a[:, None, i + 2], b[None, :, i + 2]) - np.maximum(a[:, None, i], b[None, :, i]) for i in (0, 1))


def _twentieths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of boxes in twentieths; none under one."""
    wide, tall = _met(a, b)
    r, c = np.nonzero((wide > 0) & (tall > 0))
    inter = wide[r, c] * tall[r, c]
    size = [(x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) for x in (a, b)]
    v = np.floor(inter / (size[0][r] + size[1][c] - inter) * 20 + 1e-9).astype(np.int64)
    out = np.full((len(a), len(b)), _NONE)
    out[r, c] = np.where(v > 0, v, _NONE)
    return out


def _nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of the centres of overlapping boxes in tens, negative; none beyond 15."""
    wide, tall = _met(a, b)
    r, c = np.nonzero((wide > 0) & (tall > 0))
    dx, dy = ((a[r, i] + a[r, i + 2]) / 2.0 - (b[c, i] + b[c, i + 2]) / 2.0 for i in (0, 1))
    v = np.floor(np.sqrt(dx * dx + dy * dy) / 10 + 1e-9).astype(np.int64)
    out = np.full((len(a), len(b)), _NONE)
    out[r, c] = np.where(v <= 15, -v, _NONE)
    return out


def q_j15_revival(spark, sf_dir):
    """Objects that just appeared and those that just went, matched by overlap in twentieths, greatest first; of equals by number."""
    new, gone = _changed(spark, sf_dir)
    return greedy.matched_rows(new, gone.withColumnRenamed("obj_id", "lost"), FRAME, "obj_id", "lost", _BOX, _twentieths, "overlap")


def q_j16_same_place(spark, sf_dir):
    """The same by distance, at most 150, nearest first; of equals the smaller numbers."""
    new, gone = _changed(spark, sf_dir)
    p = greedy.matched_rows(new.withColumn("r", -F.col("obj_id")), gone.withColumn("c", -F.col("obj_id")), FRAME, "r", "c", _BOX, _nearness, "near")
    return p.select(*FRAME, (-F.col("r")).alias("obj_id"), (-F.col("c")).alias("lost"), (-F.col("near")).alias("distance"))


def q_k8_pool_telemetry(spark, sf_dir):
    """One log of blocked pool writes and of the pools' sizes."""
    d = _own_cosine(spark, sf_dir).withColumn("refused", _face_reason())
    blocked = d.where("operator and refused in ('iou_overlap', 'bbox_jump')").select("video_id", "frame_idx", "gid", F.col("refused").alias("reason"))
    sizes = d.where("refused is null").groupBy("video_id", "gid").agg(F.count(F.lit(1)).alias("size"), F.least(F.count(F.lit(1)), F.lit(3)).alias("anchors"))
    return records.telemetry(warm_write_blocked=blocked, pool_stats=sizes)


def _trace(spark, sf_dir):
    """Trace rows: detections, and where chunks of 25 frames begin."""
    m = bridge.matched(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("frame_idx") / 25)).withColumn("gid", _gid())
    prev, first = F.lag("gid").over(_by_object()), F.first("frame_idx").over(_by_object())
    det = m.select(
        "video_id", "frame_idx", "chunk_id", "obj_id", (F.col("chunk_id") * 100_000 + F.col("obj_id")).alias("track_id"), (F.col("frame_idx") - first).alias("track_age"), "score", "gid", prev.alias("gid_prev"),
        F.coalesce(prev != F.col("gid"), F.lit(False)).alias("gid_changed"), (F.col("k") % 2 == 0).alias("had_face"),
    )
    begins = m.groupBy("video_id", "chunk_id").agg(F.min("frame_idx").alias("frame_idx"))
    return records.telemetry(det=det, chunk_boundary=begins)


def q_k9_trace(spark, sf_dir):
    return _trace(spark, sf_dir)


def q_a16_trace_summary(spark, sf_dir):
    """Of each video's trace: detections, chunk boundaries, and detections without an identity."""
    t = _trace(spark, sf_dir)
    c = lambda cond, name: F.count_if(cond).alias(name)
    return t.groupBy("video_id").agg(c(F.col("kind") == "det", "det_rows"), c(F.col("kind") == "chunk_boundary", "chunk_boundaries"), c((F.col("kind") == "det") & (F.col("gid") == -1), "unknown_rows"))


def q_p1_rows(spark, sf_dir):
    """Detections from a model's output, whose lists run side by side; scores fall to the row, boxes keep their object."""
    d = bridge.detections(spark, sf_dir)
    one = F.struct("obj_id", "score", F.array("x1", "y1", "x2", "y2").alias("box"))
    lists = d.groupBy(*FRAME).agg(F.array_sort(F.collect_list(one)).alias("o"))
    out = lists.select(*FRAME, F.transform("o", lambda o: o["score"]).alias("probs"), F.transform("o", lambda o: o["obj_id"]).alias("ids"), F.transform("o", lambda o: o["box"]).alias("boxes"))
    rows = out.select(*FRAME, F.inline(F.arrays_zip("probs", "ids", "boxes")))
    return rows.select(*FRAME, F.col("ids").alias("obj_id"), F.col("probs").alias("score"), F.lit("person").alias("label"), F.element_at("boxes", 1).alias("x1"), F.element_at("boxes", 4).alias("y2"))


def q_p2_rescaled(spark, sf_dir):
    """Boxes in the pixels of a frame of another size than the masks; each axis has its factor."""
    d = bridge.detections(spark, sf_dir)
    x, y = geom.scaled(geom.box(), (1000, 1660), (2160, 3840))
    return d.select("event_id", *[F.round(c, 6).alias(n) for c, n in zip((*x, *y), ("x1", "x2", "y1", "y2"), strict=True)])


def q_f18_person_crops(spark, sf_dir):
    """Where a person-centred canvas of 480 by 832 cuts the scaled frame of 1660 by 1000."""
    names = ("scale", "new_w", "new_h", "left", "top", "sx0", "sy0", "sx1", "sy1")
    out = geom.person_crop(geom.box(), (1660, 1000), (480, 832))
    return bridge.detections(spark, sf_dir).select("event_id", *[(F.round(c, 6) if n == "scale" else c).alias(n) for c, n in zip(out, names, strict=True)])


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_") and k != "q_p18_mask_sanity"}

from .geometry import SQL as _GEOMETRY  # noqa: E402
from .sequences import _SEG, _WIN  # noqa: E402

_FACES = "fc AS (SELECT event_id, k, i AS face, (k * 13 * i) % 90 AS width, CAST((k * 7 + i * 31) % 100 AS DOUBLE) / 100 AS score FROM det, generate_series(1, 3) t(i) WHERE i <= k % 4)"
_SAMPLED = "sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, obj_id ORDER BY frame_idx) - 1 AS seen, k % 2 = 0 AS has_face FROM mat) WHERE seen % 2 = 0)"
_EX2 = "ev2 AS (SELECT m.video_id, m.obj_id, m.frame_idx, m.k, m.score, x.i, x.v FROM mat m JOIN ex x USING (vec_id))"
_UPTO = "PARTITION BY video_id, obj_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING"
_SANE_PARTS, _SANE_LAST = _GEOMETRY["q_p18_mask_sanity"].split(DET_SQL, 1)[1].lstrip(", \n").rsplit("\nSELECT m.video_id", 1)
_OWN = f"""{GALLERY_SQL}, {DET_SQL}, {_SANE_PARTS}, sane AS (SELECT m.video_id{_SANE_LAST}),
 oc AS (SELECT mat.*, round(s.cos, 9) AS cos, sane.reason AS insane, k % 10 = 0 AS operator, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS low, CASE WHEN k % 8 = 1 THEN 1 ELSE 0 END AS lost, CASE WHEN k % 9 <> 0 THEN mat.gid ELSE -1 END AS g2
   FROM mat JOIN sims s ON s.vec_id = mat.vec_id AND s.gid = s.label JOIN sane ON sane.video_id = mat.video_id AND sane.frame_idx = mat.frame_idx AND sane.obj_id = mat.obj_id),
 fw AS (SELECT *, CASE WHEN g2 < 0 THEN 'unknown' WHEN score < 0.6 THEN 'score' WHEN NOT operator AND cos < 0.1 THEN 'cosine' WHEN low > 0 THEN 'streak' WHEN operator AND insane IS NOT NULL THEN insane END AS refused FROM oc),
 lf AS (SELECT *, max(CASE WHEN refused IS NULL THEN frame_idx END) OVER ({_UPTO}) AS lastf FROM fw),
 lg AS (SELECT *, CASE WHEN frame_idx - lastf <= 30 THEN lastf END AS last_face FROM lf)"""
_CHALLENGE = f"""{GALLERY_SQL}, {DET_SQL}, sr AS (SELECT vec_id, gid, round(cos, 9) AS cos FROM sims),
 rv AS (SELECT m.video_id, m.frame_idx, s.gid, max(s.cos) AS challenger FROM mat m JOIN sr s USING (vec_id) WHERE m.score < 0.5 GROUP BY ALL),
 ch AS (SELECT m.video_id, m.frame_idx, m.obj_id, m.gid, s.cos AS own, rv.challenger FROM mat m JOIN sr s ON s.vec_id = m.vec_id AND s.gid = m.gid
   LEFT JOIN rv ON rv.video_id = m.video_id AND rv.frame_idx = m.frame_idx AND rv.gid = m.gid WHERE m.score >= 0.5)"""
_CAND = f"{GALLERY_SQL}, {DET_SQL}, cd0 AS (SELECT d.event_id, d.k, s.gid, round(s.cos, 9) AS cos FROM det d JOIN sims s USING (vec_id))"
_COSTS = f"""{_CAND}, cs AS (SELECT *, (event_id + gid) % 4 AS s, CASE WHEN (event_id + gid) % 4 <> 0 THEN round(cos + ((event_id + gid) % 4) * 0.2::DOUBLE - 0.3::DOUBLE, 9) END AS warm, (k + gid) % 7 AS size FROM cd0),
 bs AS (SELECT *, CASE WHEN warm IS NULL OR size < 3 THEN 0 ELSE warm END AS warm_sim, warm IS NOT NULL AND size >= 3 AND warm >= 0.2::DOUBLE AS warm_ok, coalesce(warm > cos, false) AS warm_won FROM cs),
 bb AS (SELECT *, CASE WHEN warm_won THEN warm ELSE cos END AS blend_sim, CASE WHEN warm_won THEN warm >= 0.2::DOUBLE ELSE true END AS blend_ok FROM bs)"""
_SLOTS = f"{DET_SQL}, {_SEG}, {_WIN}, sl AS (SELECT video_id, obj_id, segment, window_idx, unnest(generate_series(start_pos, end_pos)) AS pos FROM win)"


def _greedy(order: str, value: str, keep: str, name: str) -> str:
    """The sequential rule: pairs in order, with lists of what is taken."""
    box = ", ".join(f"{c} AS l_{c}" for c in ("x1", "y1", "x2", "y2"))
    return f"""WITH RECURSIVE {DET_SQL}, new AS (SELECT * FROM det ANTI JOIN (SELECT video_id, frame_idx + 1 AS frame_idx, obj_id FROM det) USING (video_id, frame_idx, obj_id)),
 gone AS (SELECT video_id, frame_idx + 1 AS frame_idx, obj_id AS lost, {box} FROM det ANTI JOIN (SELECT video_id, frame_idx - 1 AS frame_idx, obj_id FROM det) USING (video_id, frame_idx, obj_id)),
 m AS (SELECT *, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS n1, (l_x2 - l_x1) * (l_y2 - l_y1) AS n2, CAST((least(x2, l_x2) - greatest(x1, l_x1)) * (least(y2, l_y2) - greatest(y1, l_y1)) AS DOUBLE) AS inter
  FROM new JOIN gone USING (video_id, frame_idx) WHERE x1 < l_x2 AND l_x1 < x2 AND y1 < l_y2 AND l_y1 < y2),
 v AS (SELECT *, CAST({value} AS BIGINT) AS {name} FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY {order}) AS i FROM v WHERE {keep.replace("v ", name + " ")}),
 w AS (SELECT DISTINCT video_id, frame_idx, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ur, CAST([] AS BIGINT[]) AS uc, CAST(NULL AS BIGINT) AS obj_id, CAST(NULL AS BIGINT) AS lost, CAST(NULL AS BIGINT) AS {name} FROM o
  UNION ALL SELECT video_id, frame_idx, i, CASE WHEN free THEN list_append(ur, r) ELSE ur END, CASE WHEN free THEN list_append(uc, c) ELSE uc END, CASE WHEN free THEN r END, CASE WHEN free THEN c END, CASE WHEN free THEN n END
  FROM (SELECT w.video_id, w.frame_idx, o.i, w.ur, w.uc, o.obj_id AS r, o.lost AS c, o.{name} AS n, NOT list_contains(w.ur, o.obj_id) AND NOT list_contains(w.uc, o.lost) AS free FROM w JOIN o ON o.video_id = w.video_id AND o.frame_idx = w.frame_idx AND o.i = w.i + 1))
SELECT video_id, frame_idx, obj_id, lost, {name} FROM w WHERE obj_id IS NOT NULL"""


SQL = {
    "q_p8_best_face": f"""WITH {DET_SQL}, {_FACES}, w AS (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY width DESC, face) = 1)
SELECT d.event_id, CASE WHEN w.width >= 40 THEN w.face END AS face, coalesce(w.width >= 40 AND w.score >= 0.6, false) AS sample FROM det d LEFT JOIN w USING (event_id)""",
    "q_p9_all_faces": f"WITH {DET_SQL}, {_FACES} SELECT d.event_id, coalesce(string_agg(CAST(face AS VARCHAR), ',' ORDER BY face) FILTER (fc.width >= 40 AND fc.score >= 0.6), '') AS faces FROM det d LEFT JOIN fc USING (event_id) GROUP BY d.event_id",
    "q_p11_zero_vectors": "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, CAST(min(vec_id) AS BIGINT) AS first FROM embeddings WHERE vec_id % 17 <> 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY label",
    "q_p12_evidence": f"""WITH {DET_SQL}, {_SAMPLED}, n AS (SELECT *, count(*) FILTER (has_face) OVER ({_UPTO}) AS n_face, count(*) FILTER (NOT has_face) OVER ({_UPTO}) AS n_body, bool_or(score >= 0.97) OVER ({_UPTO}) AS done FROM sp)
SELECT video_id, obj_id, frame_idx, n_face, n_body FROM n WHERE (n_face >= 3 OR n_body >= 3) AND NOT done""",
    "q_p15_consistency": f"""WITH {GALLERY_SQL}, {DET_SQL}, {_EX2},
 r AS (SELECT *, sum(v * (k + 1)) OVER o AS s, count(*) OVER o AS n FROM ev2 WHERE k % 2 = 0 WINDOW o AS (PARTITION BY video_id, obj_id, i ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT video_id, obj_id, frame_idx, max(n) AS n, max(score) AS score, round(sum(v * s) / sqrt(sum(v * v)) / sqrt(sum(s * s)), 9) AS cos FROM r GROUP BY ALL)
SELECT video_id, obj_id, frame_idx, n, coalesce(score >= 0.7 AND n >= 2 AND cos < 0, false) AS reset FROM c""",
    "q_a3_body_mean": f"""WITH {GALLERY_SQL}, {DET_SQL}, {_EX2}, r AS (SELECT *, sum(v) OVER o AS s, count(*) OVER o AS n FROM ev2 WINDOW o AS (PARTITION BY video_id, obj_id, i ORDER BY frame_idx ROWS UNBOUNDED PRECEDING))
SELECT video_id, obj_id, frame_idx, max(n) AS n, round(max(s) FILTER (i = 1) / sqrt(sum(s * s)), 6) AS first FROM r GROUP BY video_id, obj_id, frame_idx""",
    "q_p16_face_writes": f"WITH {_OWN} SELECT video_id, obj_id, frame_idx, refused FROM fw",
    "q_j19_last_face": f"WITH {_OWN} SELECT video_id, obj_id, frame_idx, last_face FROM lg",
    "q_p17_body_writes": f"""WITH {_OWN} SELECT video_id, obj_id, frame_idx, CASE WHEN g2 < 0 THEN 'unknown' WHEN low > 0 THEN 'streak' WHEN lost > 0 THEN 'column_loss'
 WHEN NOT operator AND last_face IS NULL THEN 'no_recent_face' WHEN operator AND insane IS NOT NULL THEN insane END AS refused FROM lg""",
    "q_a5_challenger": f"WITH {_CHALLENGE} SELECT video_id, frame_idx, obj_id, gid, round(own, 6) AS own, round(challenger, 6) AS challenger FROM ch",
    "q_w8_column_loss": f"""WITH {_CHALLENGE}, b AS (SELECT *, coalesce(challenger - own > 0.05::DOUBLE, false) AS bad FROM ch),
 g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, obj_id ORDER BY frame_idx) AS grp FROM b)
SELECT video_id, obj_id, frame_idx, count(*) FILTER (bad) OVER (PARTITION BY video_id, obj_id, grp ORDER BY frame_idx) AS streak FROM g""",
    "q_a18_duplicate_holders": f"""WITH {DET_SQL}, f AS (SELECT *, k % 10 = 0 AS operator, coalesce(sum(k) FILTER (k % 2 = 0) OVER ({_UPTO}), 0) AS fw, count(*) FILTER (k % 2 = 1) OVER ({_UPTO}) AS bw, count(*) OVER ({_UPTO}) AS fs FROM mat),
 r AS (SELECT *, count(*) OVER (PARTITION BY video_id, frame_idx, gid) AS n, row_number() OVER (PARTITION BY video_id, frame_idx, gid ORDER BY operator DESC, fw DESC, bw DESC, fs DESC, obj_id) AS rn FROM f),
 a AS (SELECT * FROM r WHERE n > 1 AND rn = 1)
SELECT r.video_id, r.frame_idx, r.gid, r.obj_id, a.obj_id AS anchor,
 r.obj_id <> a.obj_id AND NOT (least(r.x2, a.x2) > greatest(r.x1, a.x1) AND least(r.y2, a.y2) > greatest(r.y1, a.y1)) AS demoted
FROM r JOIN a ON a.video_id = r.video_id AND a.frame_idx = r.frame_idx AND a.gid = r.gid""",
    "q_w9_recency": f"""WITH {DET_SQL}, g AS (SELECT *, frame_idx - lag(frame_idx) OVER (PARTITION BY video_id, obj_id ORDER BY frame_idx) AS gap FROM det)
SELECT video_id, obj_id, frame_idx, gap, coalesce(gap <= 15, false) AS revive, coalesce(gap <= 5, false) AS near, coalesce(gap <= 30, false) AS trusted, coalesce(gap <= 50, false) AS reported FROM g""",
    "q_u1_live_objects": f"WITH {DET_SQL} SELECT video_id, frame_idx, string_agg(CAST(obj_id AS VARCHAR), ',' ORDER BY obj_id) AS objects, count(DISTINCT gid) AS gids FROM mat GROUP BY video_id, frame_idx",
    "q_j2_bindings": f"""WITH {DET_SQL}, b AS (SELECT video_id, obj_id, frame_idx // 25 + 1 AS chunk_id, gid AS bound, frame_idx AS seen FROM mat QUALIFY row_number() OVER (PARTITION BY video_id, obj_id, frame_idx // 25 ORDER BY frame_idx DESC) = 1)
SELECT m.video_id, m.obj_id, m.frame_idx, bound, seen FROM mat m LEFT JOIN b ON b.video_id = m.video_id AND b.obj_id = m.obj_id AND b.chunk_id = m.frame_idx // 25""",
    "q_j3_keypoints": f"WITH {DET_SQL} SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY obj_id) - 1 AS pos, gid, x1 AS point FROM mat",
    "q_j11_still_ids": f"""WITH {GALLERY_SQL}, {DET_SQL}, f AS (SELECT video_id, frame_idx, obj_id AS face_obj, vec_id, (x1 + x1 + 20 + CAST(k AS DOUBLE) / 4) / 2 AS px, y1 + 20.0::DOUBLE AS py, 20 + CAST(k AS DOUBLE) / 4 AS fw FROM det WHERE k % 2 = 0),
 j AS (SELECT p.video_id, p.frame_idx, p.obj_id, f.vec_id FROM det p LEFT JOIN f ON p.video_id = f.video_id AND p.frame_idx = f.frame_idx AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2
   QUALIFY row_number() OVER (PARTITION BY p.video_id, p.frame_idx, p.obj_id ORDER BY fw DESC NULLS LAST, face_obj) = 1),
 b AS (SELECT vec_id, gid, round(cos, 6) AS cos FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sims.cos DESC, gid) = 1)
SELECT video_id, frame_idx, obj_id, cos, CASE WHEN cos >= 0.3::DOUBLE THEN gid ELSE -1 END AS gid FROM j LEFT JOIN b USING (vec_id)""",
    "q_j12_photo_person": f"""WITH {DET_SQL}, f AS (SELECT video_id, frame_idx, x1 + 10 AS fx1, y1 + 10 AS fy1, x1 + 40 AS fx2, y1 + 50 AS fy2 FROM det QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY obj_id) = 1),
 j AS (SELECT d.*, x1 <= fx1 AND y1 <= fy1 AND x2 >= fx2 AND y2 >= fy2 AS inside FROM det d JOIN f ON f.video_id = d.video_id AND f.frame_idx = d.frame_idx)
SELECT video_id, frame_idx, obj_id, inside FROM j QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY inside DESC, score DESC, obj_id) = 1""",
    "q_j21_allowed_pairs": f"WITH {_CAND} SELECT event_id, gid FROM cd0 WHERE (event_id + gid) % 4 <> 0",
    "q_j22_operator_tracks": f"WITH {DET_SQL} SELECT video_id, obj_id, frame_idx, gid FROM mat WHERE (video_id, obj_id, gid) IN (SELECT (video_id, obj_id, gid) FROM mat WHERE event_id % 50 = 0 AND k % 2 = 0)",
    "q_f9_body_similarity": f"WITH {_COSTS} SELECT event_id, gid, round(warm_sim, 6) AS warm_sim, warm_ok, round(blend_sim, 6) AS blend_sim, blend_ok, warm_won FROM bb",
    "q_f8_pair_costs": f"""WITH {_COSTS}, p AS (SELECT *, s = 3 AS blocked, k % 20 = 0 AS by_face FROM bb)
SELECT event_id, gid, round(CASE WHEN blocked THEN 1e6::DOUBLE WHEN by_face THEN CASE WHEN warm_won AND warm < 0.2::DOUBLE THEN 1e6::DOUBLE WHEN warm_won THEN 1 - warm ELSE 1 - cos END
  WHEN NOT blend_ok THEN 1e6::DOUBLE WHEN gid % 2 = 0 THEN 0.8::DOUBLE * (1 - blend_sim) + (1 - 0.8::DOUBLE) * k / 100.0::DOUBLE ELSE 1 - blend_sim END, 6) AS cost,
 blocked OR CASE WHEN by_face THEN warm_won AND warm < 0.2::DOUBLE ELSE NOT blend_ok END AS masked FROM p""",
    "q_f11_inherit_bonus": f"WITH {_COSTS} SELECT event_id, gid, round(CASE WHEN s = 1 THEN 0.5::DOUBLE * cos WHEN s >= 2 THEN 0.1::DOUBLE * cos ELSE 0 END, 6) AS bonus FROM cs",
    "q_j24_shared_windows": f"""WITH {DET_SQL}, {_SEG}, {_WIN} SELECT a.video_id, a.obj_id, a.segment, a.window_idx AS a, b.window_idx AS b, greatest(a.start_pos, b.start_pos) AS first, least(a.end_pos, b.end_pos) AS last
FROM win a JOIN win b ON a.video_id = b.video_id AND a.obj_id = b.obj_id AND a.segment = b.segment AND a.window_idx < b.window_idx AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos""",
    "q_j15_revival": _greedy("overlap DESC, obj_id DESC, lost DESC", "floor(inter / (n1 + n2 - inter) * 20 + 1e-9)", "v > 0", "overlap"),
    "q_j16_same_place": _greedy("distance, obj_id, lost", "floor(sqrt(pow((x1 + x2) / 2.0 - (l_x1 + l_x2) / 2.0, 2) + pow((y1 + y2) / 2.0 - (l_y1 + l_y2) / 2.0, 2)) / 10 + 1e-9)", "v <= 15", "distance"),
    "q_j24_window_owners": f"WITH {_SLOTS} SELECT video_id, obj_id, segment, pos, min(window_idx) AS first, max(window_idx) AS last, count(*) AS n FROM sl GROUP BY video_id, obj_id, segment, pos",
    "q_w14_reused_frames": f"""WITH {_SLOTS}, o AS (SELECT *, min(window_idx) OVER (PARTITION BY video_id, obj_id, segment, pos) AS owner FROM sl)
SELECT video_id, obj_id, segment, window_idx, count(*) FILTER (owner < window_idx) AS reused, count(*) FILTER (owner = window_idx) AS own FROM o GROUP BY video_id, obj_id, segment, window_idx""",
    "q_u7_stored_frames": f"WITH {_SLOTS} SELECT video_id, obj_id, segment, window_idx, count(*) AS n FROM sl WHERE pos % 3 = 0 GROUP BY video_id, obj_id, segment, window_idx",
    "q_t8_window_frames": f"WITH {_SLOTS}, u AS (SELECT DISTINCT video_id, obj_id, segment, pos FROM sl) SELECT video_id, obj_id, segment, md5(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos)) AS positions, count(*) AS n FROM u GROUP BY video_id, obj_id, segment",
    "q_k8_pool_telemetry": f"""WITH {_OWN} SELECT 'warm_write_blocked' AS kind, video_id, frame_idx, gid, refused AS reason, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS anchors FROM fw WHERE operator AND refused IN ('iou_overlap', 'bbox_jump')
UNION ALL SELECT 'pool_stats', video_id, NULL, gid, NULL, count(*), least(count(*), 3) FROM fw WHERE refused IS NULL GROUP BY video_id, gid""",
    "q_k9_trace": f"""WITH {DET_SQL}, m AS (SELECT *, frame_idx // 25 AS chunk_id, CASE WHEN k % 9 <> 0 THEN gid ELSE -1 END AS g FROM mat),
 p AS (SELECT *, lag(g) OVER o AS gid_prev, frame_idx - first(frame_idx) OVER o AS track_age FROM m WINDOW o AS (PARTITION BY video_id, obj_id ORDER BY frame_idx))
SELECT 'det' AS kind, video_id, frame_idx, chunk_id, obj_id, chunk_id * 100000 + obj_id AS track_id, track_age, score, g AS gid, gid_prev, coalesce(gid_prev <> g, false) AS gid_changed, k % 2 = 0 AS had_face FROM p
UNION ALL SELECT 'chunk_boundary', video_id, min(frame_idx), chunk_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m GROUP BY video_id, chunk_id""",
    "q_a16_trace_summary": f"""WITH {DET_SQL} SELECT video_id, count(*) AS det_rows, count(DISTINCT frame_idx // 25) AS chunk_boundaries, count(*) FILTER (k % 9 = 0) AS unknown_rows FROM mat GROUP BY video_id""",
    "q_p1_rows": f"WITH {DET_SQL} SELECT video_id, frame_idx, obj_id, score, 'person' AS label, x1, y2 FROM det",
    "q_p2_rescaled": f"WITH {DET_SQL} SELECT event_id, round(x1 * (3840 / 1660.0::DOUBLE), 6) AS x1, round(x2 * (3840 / 1660.0::DOUBLE), 6) AS x2, round(y1 * (2160 / 1000.0::DOUBLE), 6) AS y1, round(y2 * (2160 / 1000.0::DOUBLE), 6) AS y2 FROM det",
    "q_f18_person_crops": f"""WITH {DET_SQL}, s AS (SELECT *, 0.8::DOUBLE * 832 / greatest(1, y2 - y1) AS scale FROM det),
 t AS (SELECT *, greatest(1, CAST(round_even(1660 * scale, 0) AS BIGINT)) AS new_w, greatest(1, CAST(round_even(1000 * scale, 0) AS BIGINT)) AS new_h,
   CAST(round_even((x1 + x2) / 2.0::DOUBLE * scale - 240, 0) AS BIGINT) AS "left", CAST(round_even((y1 + y2) / 2.0::DOUBLE * scale - 416, 0) AS BIGINT) AS top FROM s)
SELECT event_id, round(scale, 6) AS scale, new_w, new_h, "left", top, greatest(0, "left") AS sx0, greatest(0, top) AS sy0, least(new_w, "left" + 480) AS sx1, least(new_h, top + 832) AS sy1 FROM t""",
}
