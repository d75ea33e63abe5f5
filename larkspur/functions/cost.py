"""Costs of pairing an object with an identity, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFEASIBLE = 1e6


def body_similarity(kpl: Column, warm: Column, warm_size: Column, warm_only: bool = True, least: int = 3, floor: float = 0.5) -> Column:
    """struct<sim, feasible, warm_won>. Warm only: the pool alone counts, once it holds ``least`` views; else the better of
    both. A pool that wins below the floor rules the pair out."""
    row = lambda sim, ok, won: F.struct(sim.cast("double").alias("sim"), ok.alias("feasible"), won.alias("warm_won"))
    no, yes = F.lit(False), F.lit(True)
    if warm_only:
        return F.when(warm.isNull() | (F.coalesce(warm_size, F.lit(0)) < least), row(F.lit(0.0), no, no)).otherwise(row(warm, warm >= floor, yes))
    return F.when(F.coalesce(warm > kpl, no), row(warm, warm >= floor, yes)).otherwise(row(kpl, yes, no))


def pair_cost(face_kpl: Column, face_warm: Column, body: Column, spatial: Column, blocked: Column, weight: float = 0.8, floor: float = 0.5) -> Column:
    """struct<cost, masked>: face where there is a usable one (a null cosine is none), else body, with a share of place if known.

    ``body`` is a body_similarity, ``spatial`` null where there is no prediction of place or the gap is long.
    """
    row = lambda cost, masked: F.struct(cost.cast("double").alias("cost"), masked.alias("masked"))
    out, fine = row(F.lit(INFEASIBLE), F.lit(True)), F.lit(False)
    won = F.coalesce(face_warm > face_kpl, F.lit(False))
    by_face = F.when(won & (face_warm < floor), out).when(won, row(1 - face_warm, fine)).otherwise(row(1 - face_kpl, fine))
    near = 1 - body["sim"]
    by_body = F.when(~body["feasible"], out).when(spatial.isNull(), row(near, fine)).otherwise(row(F.lit(weight) * near + F.lit(1 - weight) * spatial, fine))
    return F.when(blocked, out).when(face_kpl.isNotNull(), by_face).otherwise(by_body)


def inherit_bonus(face: Column, body: Column, face_weight: float = 0.5, body_weight: float = 0.1) -> Column:
    """What likeness takes off the cost of handing state on: by face where both have one, else by body, else nothing."""
    return F.coalesce(face * face_weight, body * body_weight, F.lit(0.0))
