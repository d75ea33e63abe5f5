"""Identity resolution: an ordered fold over the frames of each video against a closed gallery."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ..functions.assign import INFEASIBLE, greedy, solve
from ..functions.pool import Pool
from .fold import ordered_fold

OUT = (
    "video_id long, chunk_id long, frame_idx long, obj_id long, gid long, path string, sim double, second_sim double, abstained string, demoted boolean, "
    "track_id long, track_age long, gid_prev long, gid_changed boolean, had_face boolean, face_weight double, body_weight double, low_streak long, n_identities long, "
    "face_pool long, body_pool long, write_blocked string"
)


@dataclass(frozen=True)
class Params:
    cadence: int = 2  # every so many frames of an object a sample counts
    confirm: int = 3  # samples that a candidate needs
    face_floor: float = 0.45
    body_floor: float = 0.50
    margin: float = 0.05
    low_face: float = 0.4
    streak: int = 5
    consistency: float = 0.3
    consistency_score: float = 0.7
    face_quality_floor: float = 0.6
    revive_iou: float = 0.5
    revive_age: int = 15
    inherit_iou: float = 0.45
    lead: float = 0.03
    column_margin: float = 0.05
    jump: float = 300.0
    stale: int = 5
    speed: float = 100.0
    warm_cap: int = 10
    warm_body_cap: int = 20
    warm_anchors: int = 3
    warm_dedup: float = 0.95
    warm_floor: float = 0.5
    warm_only: bool = False  # bodies match by the pool alone, once it holds min_warm views
    min_warm: int = 3
    min_face_score: float = 0.6
    trust: int = 30  # frames after an admitted face in which a body may enter the pool
    sane_iou: float = 0.2
    sane_jump: float = 150.0  # pixels between frames


def _unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def _overlaps(a: list[tuple], b: list[tuple], least: float, held: int = 1 << 20) -> Iterator[tuple[float, int, int]]:
    """(iou, place in a, place in b) of boxes that overlap by ``least`` (over 0), some of a at a time."""
    if not a or not b:
        return
    x, y = np.array(a, float), np.array(b, float)
    size_x, size_y = ((v[:, 2] - v[:, 0]) * (v[:, 3] - v[:, 1]) for v in (x, y))
    step = max(1, held // len(y))
    for at in range(0, len(x), step):
        p = x[at : at + step, None]
        both = np.maximum(np.minimum(p[..., 2], y[:, 2]) - np.maximum(p[..., 0], y[:, 0]), 0) * np.maximum(np.minimum(p[..., 3], y[:, 3]) - np.maximum(p[..., 1], y[:, 1]), 0)
        union = size_x[at : at + step, None] + size_y - both
        iou = np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)
        for i, j in zip(*(v.tolist() for v in np.nonzero(iou >= least)), strict=True):
            yield float(iou[i, j]), at + i, j


@dataclass
class Binding:
    """What is known of one object: evidence sums, streaks and the identities it may not take again."""

    box: tuple = ()
    before: tuple = ()
    seen: int = -1
    first: int = -1
    frames: int = 0
    gid: int = -1
    path: str = ""
    operator: bool = False
    face: np.ndarray | float = 0.0
    face_weight: float = 0.0
    n_face: int = 0
    body: np.ndarray | float = 0.0
    n_body: int = 0
    low: int = 0
    lost: int = 0
    last_face: int | None = None  # the frame of the last face admitted to a pool
    prev: int | None = None
    blocked: set = field(default_factory=set)

    def mean(self, kind: str) -> np.ndarray | None:
        some = self.n_face if kind == "face" else self.n_body
        return _unit(getattr(self, kind)) if some else None

    def forget(self) -> None:
        self.face, self.face_weight, self.n_face, self.body, self.n_body, self.low, self.lost = 0.0, 0.0, 0, 0.0, 0, 0, 0

    def demote(self) -> None:
        self.blocked.add(self.gid)
        self.gid, self.path, self.operator = -1, "", False
        self.forget()


class Resolver:
    """Called with the rows of one frame at a time: obj_id, box, optional samples (face, face_quality, face_score, body), set_gid."""

    def __init__(self, gids: list[int], centroids: np.ndarray, p: Params = Params()) -> None:
        self.gids, self.centroids, self.p = gids, centroids, p
        self.live: dict[int, Binding] = {}
        self.handed: list[Binding] = []
        self.chunk, self.last_seen = None, {}
        self.pools: dict[tuple[int, str], Pool] = {}

    def __call__(self, rows: list[dict]) -> list[dict]:
        frame, chunk = rows[0]["frame_idx"], rows[0]["chunk_id"]
        first = chunk != self.chunk
        if first:
            newest = max((b.seen for b in self.live.values()), default=-1)
            self.handed = [b for b in self.live.values() if b.seen == newest and (b.gid >= 0 or b.n_face or b.n_body)]
            self.live, self.chunk = {}, chunk
        boxes = {r["obj_id"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows}
        if first:
            self._inherit(rows, boxes)
        else:
            self._revive(boxes, frame)
        demoted: set[int] = set()
        samples: dict[int, np.ndarray] = {}
        bodies: dict[int, np.ndarray] = {}
        for r in rows:
            b = self.live.setdefault(r["obj_id"], Binding())
            b.before, b.box = b.box, boxes[r["obj_id"]]
            b.first = frame if b.first < 0 else b.first
            if r.get("set_gid") is not None:
                b.gid, b.path, b.operator = r["set_gid"], "operator", True
            if b.frames % self.p.cadence == 0:
                self._observe(b, r, samples, bodies)
            b.frames, b.seen = b.frames + 1, frame
        here = [r["obj_id"] for r in rows]
        self._streaks(here, samples, bodies, demoted)
        reasons = self._confirm(here, frame)
        self._unique(here, demoted)
        refused: dict[int, str] = {}
        for r in rows:
            o = r["obj_id"]
            b = self.live[o]
            if b.gid >= 0:
                self.last_seen[b.gid] = (frame, (b.box[0] + b.box[2]) / 2, (b.box[1] + b.box[3]) / 2)
                insane = self._insane(o, here) if b.operator else None
                if insane and (o in samples or o in bodies):
                    refused[o] = insane
                self._remember(b, samples.get(o), bodies.get(o), r.get("face_score") or 0.0, frame, insane)
        return [self._row(r, reasons, demoted, refused, samples) for r in rows]

    def _row(self, r: dict, reasons: dict, demoted: set, refused: dict, samples: dict) -> dict:
        b = self.live[r["obj_id"]]
        prev, b.prev = b.prev, b.gid
        kind = "face" if b.n_face else "body"
        mean = b.mean(kind)
        sims = self.centroids @ mean if mean is not None and b.gid in self.gids else None
        own = self.gids.index(b.gid) if sims is not None else None
        others = np.delete(sims, own) if sims is not None else np.empty(0)
        return {
            "video_id": r["video_id"], "chunk_id": r["chunk_id"], "frame_idx": r["frame_idx"], "obj_id": r["obj_id"], "gid": b.gid, "path": b.path or None,
            "sim": float(sims[own]) if sims is not None else None, "second_sim": float(others.max()) if len(others) else None,
            "abstained": reasons.get(r["obj_id"]), "demoted": r["obj_id"] in demoted, "track_id": r["chunk_id"] * 100_000 + r["obj_id"], "track_age": r["frame_idx"] - b.first, "gid_prev": prev,
            "gid_changed": prev is not None and prev != b.gid, "had_face": r["obj_id"] in samples, "face_weight": float(b.face_weight), "body_weight": float(b.n_body), "low_streak": b.low,
            "n_identities": len(self.gids), "face_pool": self._pool_size(b.gid, "face"), "body_pool": self._pool_size(b.gid, "body"), "write_blocked": refused.get(r["obj_id"]),
        }

    def _pool_size(self, gid: int, kind: str) -> int:
        return len(self.pools[gid, kind].vectors) if (gid, kind) in self.pools else 0

    def _observe(self, b: Binding, r: dict, samples: dict, bodies: dict) -> None:
        if r.get("face") is not None and (r.get("face_quality") or 0) > 0:
            e, q = _unit(r["face"]), r["face_quality"]
            mean = b.mean("face")
            if mean is not None and b.n_face >= 2 and (r.get("face_score") or 0) >= self.p.consistency_score and float(mean @ e) < self.p.consistency:
                b.face, b.face_weight, b.n_face = 0.0, 0.0, 0
            else:
                b.face, b.face_weight, b.n_face = b.face + e * q, b.face_weight + q, b.n_face + 1
            samples[r["obj_id"]] = e
        if r.get("body") is not None and any(r["body"]):
            bodies[r["obj_id"]] = e = _unit(r["body"])
            b.body, b.n_body = b.body + e, b.n_body + 1

    def _revive(self, boxes: dict, frame: int) -> None:
        """Objects that have just vanished lend their state to new ones where they were, best overlap first."""
        gone = [o for o, b in self.live.items() if o not in boxes and frame - b.seen <= self.p.revive_age]
        new = [o for o in boxes if o not in self.live]
        scores = list(_overlaps([boxes[o] for o in new], [self.live[g].box for g in gone], self.p.revive_iou))
        for i, j in greedy(scores):
            self.live[new[i]] = self.live.pop(gone[j])

    def _inherit(self, rows: list[dict], boxes: dict) -> None:
        """At the start of a chunk ids begin anew: rows take over what was handed on, at the least total of distance less likeness."""
        if self.handed:
            cost = np.full((len(rows), len(self.handed)), INFEASIBLE)
            for near, i, j in _overlaps([boxes[r["obj_id"]] for r in rows], [b.box for b in self.handed], self.p.inherit_iou):
                r, b, bonus = rows[i], self.handed[j], 0.0
                for kind, weight in (("face", 0.5), ("body", 0.1)):
                    if r.get(kind) is not None and b.mean(kind) is not None:
                        bonus = weight * float(_unit(r[kind]) @ b.mean(kind))
                        break
                cost[i, j] = 1 - near - bonus
            for i, j in solve(cost):
                if cost[i, j] < INFEASIBLE:
                    self.live[rows[i]["obj_id"]] = self.handed[j]
                    self.handed[j].low = 0
        self.handed = []

    def _streaks(self, here: list[int], samples: dict, bodies: dict, demoted: set) -> None:
        held = [o for o in here if self.live[o].gid in self.gids and not self.live[o].operator]
        for o in held:
            b = self.live[o]
            own = self.gids.index(b.gid)
            if o in samples:
                sims = self.centroids @ samples[o]
                mean = b.mean("face")
                backed = mean is not None and (int((self.centroids @ mean).argmax()) == own or float(self.centroids[own] @ mean) >= self.p.low_face)
                b.low = b.low + 1 if int(sims.argmax()) != own and sims[own] < self.p.low_face and not backed else 0
            if not b.n_face and o in bodies:
                rivals = [float(self.centroids[own] @ bodies[c]) for c in here if self.live[c].gid < 0 and c in bodies]
                lost = rivals and max(rivals) - float(self.centroids[own] @ bodies[o]) > self.p.column_margin
                b.lost = b.lost + 1 if lost else 0
            if max(b.low, b.lost) >= self.p.streak:
                b.demote()
                demoted.add(o)

    def _similarity(self, b: Binding, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean with each identity, by centroid and by the better of centroid and pool; pools below the floor rule a pair out."""
        mean = b.mean(kind)
        kpl = self.centroids @ mean
        best = kpl.copy()
        for i, g in enumerate(self.gids):
            warm = self.pools[g, kind].best(mean) if (g, kind) in self.pools else None
            if kind == "body" and self.p.warm_only:
                best[i] = warm if warm is not None and self._pool_size(g, kind) >= self.p.min_warm and warm >= self.p.warm_floor else -INFEASIBLE
            elif warm is not None and warm > kpl[i]:
                best[i] = warm if warm >= self.p.warm_floor else -INFEASIBLE
        return kpl, best

    def _confirm(self, here: list[int], frame: int) -> dict[int, str]:
        taken = {b.gid for b in self.live.values() if b.gid >= 0}
        ready = [o for o in here if self.live[o].gid < 0 and max(self.live[o].n_face, self.live[o].n_body) >= self.p.confirm]
        free = [i for i, g in enumerate(self.gids) if g not in taken]
        if not ready:
            return {}
        kinds = {o: "face" if self.live[o].n_face else "body" for o in ready}
        sims = {o: self._similarity(self.live[o], kinds[o]) for o in ready}
        why = {o: "gid_taken" if self.gids[int(sims[o][0].argmax())] in taken else "no_free_match" for o in ready}
        cost = np.full((len(ready), len(free)), INFEASIBLE)
        for r, o in enumerate(ready):
            for c, i in enumerate(free):
                if self.gids[i] not in self.live[o].blocked and sims[o][1][i] > -INFEASIBLE:
                    cost[r, c] = 1 - sims[o][1][i]
        for r, c in solve(cost):
            if cost[r, c] >= INFEASIBLE:
                continue
            o, i = ready[r], free[c]
            reason = self._refused(self.live[o], kinds[o], sims[o], i, free, frame)
            if reason is None:
                b = self.live[o]
                b.gid, b.path, b.low, b.lost = self.gids[i], kinds[o], 0, 0
                why.pop(o)
            elif why[o] != "gid_taken":
                why[o] = reason
        return why

    def _refused(self, b: Binding, kind: str, sims: tuple, i: int, free: list[int], frame: int) -> str | None:
        """Why a match is not confirmed. The runner-up is the best of the identities that are free; looks are compared with all."""
        kpl, best = sims
        second = max((float(best[j]) for j in free if j != i), default=-np.inf)
        if kind == "face":
            if best[i] < self.p.face_floor:
                return "gate"
            if kpl[i] < self.p.face_floor:
                return "kpl_disagree"
        elif best[i] < self.p.body_floor or best[i] - second < self.p.margin:
            return "gate"
        elif kpl[i] - max(np.delete(kpl, i), default=-np.inf) < self.p.lead:
            return "ambiguous"
        if self.gids[i] in self.last_seen:
            then, x, y = self.last_seen[self.gids[i]]
            d = float(np.hypot((b.box[0] + b.box[2]) / 2 - x, (b.box[1] + b.box[3]) / 2 - y))
            gap = frame - then
            if d > self.p.jump and (gap <= self.p.stale or kind == "body" and d / max(1, gap) > self.p.speed):
                return "locality"
        return None

    def _unique(self, here: list[int], demoted: set) -> None:
        """Of several holders of an identity in one frame the best founded stays; others that stand apart from it lose it."""
        holders: dict[int, list[int]] = {}
        for o in here:
            if self.live[o].gid >= 0:
                holders.setdefault(self.live[o].gid, []).append(o)
        for group in holders.values():
            if len(group) > 1:
                rank = lambda o: (self.live[o].operator, self.live[o].face_weight, self.live[o].n_body, self.live[o].frames)
                anchor = max(group, key=rank)
                for o in group:
                    if o != anchor and _iou(self.live[o].box, self.live[anchor].box) <= 0:
                        self.live[o].demote()
                        demoted.add(o)

    def _insane(self, o: int, here: list[int]) -> str | None:
        """Why an operator's object may be another than it was: it overlaps with a neighbour, or has jumped."""
        b = self.live[o]
        if any(c != o and _iou(b.box, self.live[c].box) > self.p.sane_iou for c in here):
            return "iou_overlap"
        if b.before and np.hypot(sum(b.box[::2]) - sum(b.before[::2]), sum(b.box[1::2]) - sum(b.before[1::2])) / 2 > self.p.sane_jump:
            return "bbox_jump"
        return None

    def _remember(self, b: Binding, face: np.ndarray | None, body: np.ndarray | None, score: float, frame: int, insane: str | None) -> None:
        """What may enter the pools of an object's identity: sure faces that look like it, and bodies of which a face has told lately."""
        if b.low or insane or b.gid not in self.gids:
            return
        own = self.centroids[self.gids.index(b.gid)]
        if face is not None and score >= self.p.min_face_score and (b.operator or float(own @ face) >= self.p.low_face):
            if self._pool(b.gid, "face").write(face) in ("added", "replaced"):
                b.last_face = frame
        recent = b.last_face is not None and frame - b.last_face <= self.p.trust
        if body is not None and not b.lost and (b.operator or recent):
            self._pool(b.gid, "body").write(body)

    def _pool(self, gid: int, kind: str) -> Pool:
        cap = self.p.warm_cap if kind == "face" else self.p.warm_body_cap
        return self.pools.setdefault((gid, kind), Pool(cap, self.p.warm_anchors, self.p.warm_dedup))


MAX_GALLERY = 100_000  # identities: a closed registry that every task holds


def gallery_arrays(gallery: DataFrame) -> tuple[list[int], np.ndarray]:
    rows = sorted((r["gid"], r["centroid"]) for r in gallery.select("gid", "centroid").limit(MAX_GALLERY + 1).collect())
    if len(rows) > MAX_GALLERY:
        raise ValueError(f"a gallery of more than {MAX_GALLERY} identities can't be resolved in one machine")
    return [g for g, _ in rows], np.array([c for _, c in rows], float)


def resolve(rows: DataFrame, gallery: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (video_id, chunk_id, frame_idx, obj_id, x1..y2, face, face_quality, face_score, body, set_gid) with their identity, -1 if unknown.

    Videos are independent and each is read in the order of chunk, frame and object; its rows stream through one task.
    """
    gids, centroids = gallery_arrays(gallery)
    return ordered_fold(rows, ["video_id"], ["chunk_id", "frame_idx"], ["obj_id"], lambda: Resolver(gids, centroids, p), OUT)
