"""Evidence for and against identities: admission of samples, duplicate holders, pool writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom


def widest(faces: Column, min_width: float = 40.0, min_score: float | None = None) -> Column:
    """The widest of array<struct<width, score, ...>>, the first of equals; null if it is too narrow or, where a score is asked for, too weak."""
    ranked = F.transform(faces, lambda f, i: F.struct(f["width"].alias("w"), (-i).alias("first"), f.alias("f")))
    best = F.array_max(ranked)["f"]
    ok = best["width"] >= min_width
    return F.when(ok if min_score is None else ok & (best["score"] >= min_score), best)


def passing(faces: Column, min_width: float = 40.0, min_score: float = 0.6) -> Column:
    return F.filter(faces, lambda f: (f["width"] >= min_width) & (f["score"] >= min_score))


def inconsistent(cos: Column, n: Column, score: Column, cos_floor: float = 0.3, score_floor: float = 0.7) -> Column:
    """Whether a sure new face is unlike the mean of two or more before it: a sign that the object has changed hands."""
    return F.coalesce((score >= score_floor) & (n >= 2) & (cos < cos_floor), F.lit(False))


def face_write(gid: Column, score: Column, cos: Column, operator: Column, low_streak: Column, insane: Column, min_score: float = 0.6, low: float = 0.4) -> Column:
    """Why a face may not enter its identity's pool, or null if it may. ``insane``: the reason of a mask check, for operators' objects."""
    return (
        F.when(gid < 0, "unknown").when(score < min_score, "score").when(~operator & (cos < low), "cosine").when(low_streak > 0, "streak").when(operator & insane.isNotNull(), insane)
    )


def body_write(gid: Column, low_streak: Column, lost_streak: Column, operator: Column, since_face: Column, insane: Column, trust: int = 30) -> Column:
    """The same for a body: no streak may run, and unless an operator says so a face must have been confirmed at most ``trust`` frames ago."""
    stale = ~operator & F.coalesce(since_face > trust, F.lit(True))
    return F.when(gid < 0, "unknown").when(low_streak > 0, "streak").when(lost_streak > 0, "column_loss").when(stale, "no_recent_face").when(operator & insane.isNotNull(), insane)


def challengers(rows: DataFrame, frame: list[str], obj: str = "obj_id") -> DataFrame:
    """(frame, obj, gid, own, challenger): for each confirmed row, the best cosine that unconfirmed rows of its frame have with its identity.

    rows(frame, obj, gid, confirmed, sims array<struct<cos, gid>>). Maxima by frame and identity meet the confirmed rows by key; no rows are paired.
    """
    rivals = rows.where(~F.col("confirmed")).select(*frame, F.inline("sims")).groupBy(*frame, "gid").agg(F.max("cos").alias("challenger"))
    own = F.element_at(F.filter("sims", lambda s: s["gid"] == F.col("gid")), 1)["cos"]
    held = rows.where("confirmed").withColumn("own", own).select(*frame, obj, "gid", "own")
    return held.join(rivals, [*frame, "gid"], "left")


def holders(rows: DataFrame, frame: list[str], obj: str = "obj_id") -> DataFrame:
    """(frame, gid, obj, anchor, demoted) where several objects of a frame hold an identity.

    The anchor is the one with an operator's word, then most face weight, then body weight, then frames seen; of equals the first by obj. Others
    whose boxes don't touch its box lose the identity.
    """
    rank = F.struct("operator", "face_weight", "body_weight", "frames_seen", (-F.col(obj)).alias("neg"), "x1", "y1", "x2", "y2")
    best = rows.where("gid >= 0").groupBy(*frame, "gid").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("a")).where("n > 1")
    held = rows.join(best, [*frame, "gid"])
    apart = geom.iou(geom.box(), [F.col(f"a.{c}") for c in ("x1", "y1", "x2", "y2")]) <= 0
    return held.select(*frame, "gid", obj, (-F.col("a.neg")).alias("anchor"), ((F.col(obj) != -F.col("a.neg")) & apart).alias("demoted"))
