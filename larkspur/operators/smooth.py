"""Smoothing of keypoint tracks, and the trigger for objects that stay unknown."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .fold import Machine, ordered_fold


@dataclass(frozen=True)
class OneEuro:
    min_cutoff: float = 0.1
    beta: float = 0.02
    d_cutoff: float = 1.0
    floor: float = 0.3
    reset: int = 5


def _alpha(cutoff, dt: float):
    return 1.0 / (1.0 + 1.0 / (2.0 * math.pi * cutoff) / dt)


def one_euro(p: OneEuro = OneEuro()) -> Machine:
    """Steps with (frame_idx, xs, conf): valid points are low-passed at a cutoff that grows with speed, others are held."""
    state: dict = {}

    def step(rows: list[dict]) -> list[dict]:
        r = rows[0]
        x, ok = np.array(r["xs"], float), np.array(r["conf"], float) >= p.floor
        gap = r["frame_idx"] - state.get("frame", r["frame_idx"])
        if not state or gap > p.reset or len(x) != len(state["x"]):
            state.update(x=x.copy(), v=np.zeros(len(x)), known=ok.copy())
        else:
            dt = float(gap) if gap > 0 else 1.0
            live, new = ok & state["known"], ok & ~state["known"]
            v = state["v"] + _alpha(p.d_cutoff, dt) * ((x - state["x"]) / dt - state["v"])
            moved = state["x"] + _alpha(p.min_cutoff + p.beta * np.abs(v), dt) * (x - state["x"])
            state["v"] = np.where(live, v, state["v"])
            state["x"] = np.where(live, moved, np.where(new, x, state["x"]))
            state["known"] |= ok
        state["frame"] = r["frame_idx"]
        return [{**q, "smooth": state["x"].tolist()} for q in rows[:1]]

    return step


def smoothed(rows: DataFrame, p: OneEuro = OneEuro()) -> DataFrame:
    """(video_id, obj_id, frame_idx, smooth) from xs and conf arrays; one row per object and frame counts."""
    return ordered_fold(rows, ["video_id", "obj_id"], ["frame_idx"], [], lambda: one_euro(p), "video_id long, obj_id long, frame_idx long, smooth array<double>")


def new_unknown(sustained: int = 10, radius: float = 90.0, recent: int = 50) -> Machine:
    """Fires once for each place where an unknown has been seen in ``sustained`` steps; unseen places are dropped after ``recent`` frames."""
    slots: list[dict] = []

    def step(rows: list[dict]) -> list[dict]:
        frame, fired = rows[0]["frame_idx"], []
        slots[:] = [s for s in slots if frame - s["seen"] <= recent]
        centres = [((r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2) for r in rows]
        pairs = sorted((d, i, j) for i, c in enumerate(centres) for j, s in enumerate(slots) if (d := math.hypot(c[0] - s["at"][0], c[1] - s["at"][1])) <= radius)
        used_rows, used_slots = {}, set()
        for _, i, j in pairs:
            if i not in used_rows and j not in used_slots:
                used_rows[i] = slots[j]
                used_slots.add(j)
        for i, c in enumerate(centres):
            s = used_rows.get(i)
            if s is None:
                slots.append(s := {"streak": 0, "done": False})
            s.update(at=c, seen=frame, streak=s["streak"] + 1)
            if s["streak"] >= sustained and not s["done"]:
                s["done"] = True
                fired.append({"video_id": rows[i]["video_id"], "frame_idx": frame, "obj_id": rows[i]["obj_id"], "streak": s["streak"]})
        return fired

    return step


def sustained_unknowns(rows: DataFrame, **options) -> DataFrame:
    return ordered_fold(rows, ["video_id"], ["frame_idx"], ["obj_id"], lambda: new_unknown(**options), "video_id long, frame_idx long, obj_id long, streak long")
