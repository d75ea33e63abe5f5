"""Confidence, mask-quality and locality gates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confirmed_via(path: Column, sim: Column, second: Column, n: Column, face_floor: float = 0.45, abs_floor: float = 0.50, margin: float = 0.05) -> Column:
    """'face', 'osnet' or 'none'. Comparisons are inclusive; the body path needs a margin if there is a runner-up."""
    apart = (n <= 1) | second.isNull() | (sim - second >= margin)
    return F.when((path == "face") & (sim >= face_floor), "face").when((path != "face") & (sim >= abs_floor) & apart, "osnet").otherwise("none")


def mask_quality(mask_area: Column, box_area: Column, score: Column, source: Column, ratio_floor: float = 0.2, score_floor: float = 0.5, override: float = 0.85) -> Column:
    """struct<kind, value, floor> with kind Pass, FailNone, FailScore or FailRatio; a null mask_area means no mask."""
    outcome = lambda kind, v, f: F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value"), f.cast("double").alias("floor"))
    null = F.lit(None)
    own = source == "detection"
    ratio = F.when(box_area > 0, mask_area / box_area)
    return (
        F.when(mask_area.isNull(), outcome("FailNone", null, null))
        .when(own & (score < score_floor), outcome("FailScore", score, F.lit(score_floor)))
        .when(ratio.isNull(), outcome("FailRatio", F.lit(0.0), F.lit(ratio_floor)))
        .when((ratio < ratio_floor) & ~F.coalesce(own & (score >= override), F.lit(False)), outcome("FailRatio", ratio, F.lit(ratio_floor)))
        .otherwise(outcome("Pass", null, null))
    )


def locality_ok(gap: Column, distance: Column, path: Column, max_stale: int = 5, max_jump: float = 300.0, max_speed: float = 100.0) -> Column:
    """Whether an identity last seen ``gap`` frames ago at ``distance`` pixels may be here; yes if never seen."""
    fast = (path == "osnet") & (distance > max_jump) & (distance / F.greatest(F.lit(1), gap) > max_speed)
    return F.when(gap.isNull() | distance.isNull(), True).when(gap > max_stale, ~fast).otherwise(distance <= max_jump)


def within_motion(distance: Column, last_diagonal: Column, eps: float = 0.15) -> Column:
    return F.coalesce(distance <= last_diagonal * eps, F.lit(False))


def augmented(kpl: Column, warm: Column) -> tuple[Column, Column]:
    """(similarity, whether the warm pool strictly won)."""
    won = F.coalesce(warm > kpl, F.lit(False))
    return F.when(won, warm).otherwise(kpl), won
