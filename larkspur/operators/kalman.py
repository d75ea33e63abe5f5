"""Constant-velocity filter of box tracks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import Machine, ordered_fold


@dataclass(frozen=True)
class Noise:
    """Variances for centre x, centre y, width and height."""

    place: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)  # added to a place with each frame
    speed: tuple[float, ...] = (0.01, 0.01, 0.0001, 0.0001)  # added to a speed with each frame
    seen: tuple[float, ...] = (1.0, 1.0, 10.0, 10.0)  # of an observation
    first_place: float = 10.0
    first_speed: float = 1e4


def box_filter(p: Noise = Noise()) -> Machine:
    """Steps with (frame_idx, z), z being centre x, centre y, width, height.

    All matrices of the model are diagonal by coordinate, so each coordinate is a filter of its own with a place, a speed and
    three covariances. Frames without an observation have a closed form and cost nothing.
    """
    place, speed, seen = np.array(p.place), np.array(p.speed), np.array(p.seen)
    s: dict = {}

    def ahead(n: int) -> None:
        pp, pv, vv = s["pp"], s["pv"], s["vv"]
        s["x"] = s["x"] + n * s["v"]
        s["pp"] = pp + 2 * n * pv + n * n * vv + n * place + speed * ((n - 1) * n * (2 * n - 1) / 6)
        s["pv"] = pv + n * vv + speed * (n * (n - 1) / 2)
        s["vv"] = vv + n * speed

    def step(rows: list[dict]) -> list[dict]:
        r = rows[0]
        z = np.array(r["z"], float)
        if not s:
            s.update(x=z, v=np.zeros(4), pp=np.full(4, p.first_place), pv=np.zeros(4), vv=np.full(4, p.first_speed))
            expected = z
        else:
            ahead(r["frame_idx"] - s["frame"])
            expected = s["x"]
            total = s["pp"] + seen
            gain, gain_v, off = s["pp"] / total, s["pv"] / total, z - s["x"]
            s.update(x=s["x"] + gain * off, v=s["v"] + gain_v * off, pp=s["pp"] * (1 - gain), pv=s["pv"] * (1 - gain), vv=s["vv"] - gain_v * s["pv"])
        s["frame"] = r["frame_idx"]
        return [{**r, "predicted": _corners(expected), "filtered": _corners(s["x"])}]

    return step


def _corners(x: np.ndarray) -> list[float]:
    return [*(x[:2] - x[2:] / 2).tolist(), *(x[:2] + x[2:] / 2).tolist()]


def filtered_boxes(detections: DataFrame, p: Noise = Noise()) -> DataFrame:
    """(video_id, obj_id, frame_idx, predicted, filtered): boxes as x1, y1, x2, y2 before and after each observation.

    Rows without a frame or a corner are no observations. Of several rows of an object in a frame the first by corners counts.
    """
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    z = F.array((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)
    rows = detections.dropna(subset=["frame_idx", "x1", "y1", "x2", "y2"]).select("video_id", "obj_id", "frame_idx", z.alias("z"))
    out = "video_id long, obj_id long, frame_idx long, predicted array<double>, filtered array<double>"
    return ordered_fold(rows, ["video_id", "obj_id"], ["frame_idx"], ["z"], lambda: box_filter(p), out)
