"""Queries whose rules feed back on themselves; SQL can't express them. Tests hold their rules against brute force and scenes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import assign, vec
from ..functions.pool import Pool
from ..operators import fold, matching, resolver, smooth
from ..sources import bridge


def _samples(spark, sf_dir):
    v = bridge.vectors(spark, sf_dir).select("vec_id", "embedding")
    d = bridge.detections(spark, sf_dir).join(v, "vec_id")
    return d.select(
        "video_id", F.floor(F.col("frame_idx") / 25).alias("chunk_id"), "frame_idx", "obj_id", "x1", "y1", "x2", "y2",
        F.when(F.col("k") % 2 == 0, F.col("embedding")).alias("face"), F.col("score").alias("face_quality"), F.col("score").alias("face_score"), F.col("embedding").alias("body"),
    )


def q_r_resolver(spark, sf_dir):
    p = resolver.Params(face_floor=0.25, body_floor=0.25, low_face=0.15, warm_floor=0.25, warm_dedup=0.3)
    return resolver.resolve(_samples(spark, sf_dir), bridge.gallery(spark, sf_dir), p)


def q_j13_assignment(spark, sf_dir):
    """Objects of a frame one-to-one with identities at the least total of one less the cosine; frames are independent."""
    keys = ["video_id", "frame_idx", "obj_id"]
    sims = matching.merged(matching.similarities(_samples(spark, sf_dir).select(*keys, "body"), bridge.gallery(spark, sf_dir), "body"), keys)
    rows = sims.select(*keys, F.transform("sims", lambda s: s["cos"]).alias("cos"), F.transform("sims", lambda s: s["gid"]).alias("gids"))

    def step(rows: list[dict]) -> list[dict]:
        cost = 1 - np.array([r["cos"] for r in rows])
        return [{**{k: rows[i][k] for k in ("video_id", "frame_idx", "obj_id")}, "gid": rows[i]["gids"][j], "cos": float(1 - cost[i, j])} for i, j in assign.solve(cost)]

    return fold.ordered_fold(rows, ["video_id", "frame_idx"], [], ["obj_id"], lambda: step, "video_id long, frame_idx long, obj_id long, gid long, cos double")


def q_w15_one_euro(spark, sf_dir):
    d = bridge.detections(spark, sf_dir)
    xs = d.select("video_id", "obj_id", "frame_idx", F.array(F.col("x1").cast("double"), F.col("y1").cast("double")).alias("xs"), F.array("score", "score").alias("conf"))
    return smooth.smoothed(xs)


def q_r22_new_unknown(spark, sf_dir):
    return smooth.sustained_unknowns(bridge.detections(spark, sf_dir).where("score >= 0.5"))


def q_r16_warm_pool(spark, sf_dir):
    """What becomes of each vector offered to its identity's pool."""
    v = bridge.vectors(spark, sf_dir).select("label", "vec_id", vec.unit(F.col("embedding")).alias("u"))

    def machine():
        pool = Pool(cap=10, anchors=3, dedup=0.30)
        return lambda rows: [{"label": r["label"], "vec_id": r["vec_id"], "outcome": pool.write(np.array(r["u"])), "size": len(pool.vectors)} for r in rows]

    return fold.ordered_fold(v, ["label"], ["vec_id"], [], machine, "label long, vec_id long, outcome string, size long")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
SQL: dict[str, str] = {}
