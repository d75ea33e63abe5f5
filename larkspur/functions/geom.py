"""Box arithmetic. A box is four columns (x1, y1, x2, y2); rounding is half-even, as the rules ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(prefix: str = "", table: str = "") -> Box:
    at = f"{table}." if table else ""
    return [F.col(f"{at}{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where both boxes are empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    both = (w * h).cast("double")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0


def centre_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def diagonal(b: Box) -> Column:
    """Sides count as one pixel at least; 1 for a null box."""
    w, h = F.greatest(b[2] - b[0], F.lit(1)).cast("double"), F.greatest(b[3] - b[1], F.lit(1)).cast("double")
    return F.when(b[0].isNull(), 1.0).otherwise(F.sqrt(w * w + h * h))


def contains(b: Box, x: Column, y: Column) -> Column:
    return (b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3])


def round16(x: Column) -> Column:
    return F.greatest(F.lit(16).cast("long"), (F.bround(x / 16.0) * 16).cast("long"))


def window_length(n: Column) -> Column:
    """The largest 4k + 1 that n frames hold, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor((n - 1) / 4) * 4 + 1)


def odd_kernel(height: Column, least: int = 51, frac: float = 0.20) -> Column:
    k = F.greatest(F.lit(least).cast("long"), F.bround(height * frac).cast("long"))
    return k + F.when(k % 2 == 0, 1).otherwise(0)


def share_of(size: Column, least: int, frac: float) -> Column:
    return F.greatest(F.lit(least).cast("long"), F.bround(size * frac).cast("long"))


def face_quality(score: Column, face_area: Column, body_area: Column) -> Column:
    return F.when(body_area > 0, score * F.sqrt(F.least(F.lit(1.0), face_area / body_area))).otherwise(0.0)


def spatial_cost(distance: Column, scale: float = 300.0) -> Column:
    return 1.0 - F.greatest(F.lit(0.0), 1.0 - distance / scale)


def crop_rect(b: Box, width: int, height: int) -> list[Column]:
    """(y0, x0, y1, x1): the integer rectangle around a box, inside the image."""
    clamp = lambda v, hi: F.greatest(F.lit(0).cast("long"), F.least(F.lit(hi).cast("long"), v.cast("long")))
    return [clamp(F.floor(b[1]), height), clamp(F.floor(b[0]), width), clamp(F.ceil(b[3]), height), clamp(F.ceil(b[2]), width)]


def letterbox(w: Column, h: Column, width: int, height: int) -> list[Column]:
    """(x0, y0, w, h): an image as large as fits the canvas, centred; sides round half-even, margins down."""
    scale = F.least(F.lit(float(width)) / w, F.lit(float(height)) / h)
    nw, nh = F.bround(w * scale).cast("long"), F.bround(h * scale).cast("long")
    return [F.floor((width - nw) / 2), F.floor((height - nh) / 2), nw, nh]


def to_crop(x: Column, y: Column, rect: Sequence[Column], width: int, height: int) -> tuple[Column, Column]:
    """A point of the image in the pixels of a crop (y0, x0, y1, x1) that is resized to width by height."""
    sx = F.lit(float(width)) / F.greatest(F.lit(1).cast("long"), rect[3] - rect[1])
    sy = F.lit(float(height)) / F.greatest(F.lit(1).cast("long"), rect[2] - rect[0])
    return (x - rect[1]) * sx, (y - rect[0]) * sy


def body_from_face(face: Box, width: int, height: int) -> list[Column]:
    """(x1, y1, x2, y2) of the body a face suggests: 3 widths, 7.5 heights down from the face's top and a fifth above; all of the image for a null face."""
    w, h = F.greatest(F.lit(1.0), face[2] - face[0]), F.greatest(F.lit(1.0), face[3] - face[1])
    mid = (face[0] + face[2]) / 2.0
    raw = [(mid - w * 1.5, width, 0), (face[1] - h * 0.2, height, 0), (mid + w * 1.5, width, width), (face[1] + h * 7.5, height, height)]
    return [F.when(face[0].isNull(), F.lit(none).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.lit(hi).cast("long"), F.bround(v).cast("long")))) for v, hi, none in raw]


def track_id(chunk: Column, obj: Column) -> Column:
    return chunk * 100_000 + obj


def scaled(b: Box, size: tuple[int, int], to: tuple[int, int]) -> tuple[list[Column], list[Column]]:
    """((x1, x2), (y1, y2)) of a box when an image of (height, width) becomes another; each axis has its own factor."""
    sx, sy = F.lit(to[1] / size[1]), F.lit(to[0] / size[0])
    return [b[0] * sx, b[2] * sx], [b[1] * sy, b[3] * sy]


def person_crop(b: Box, image: tuple[int, int], canvas: tuple[int, int], share: float = 0.8) -> list[Column]:
    """(scale, new_w, new_h, left, top, sx0, sy0, sx1, sy1): the image scaled so that the box's height is a share of the canvas
    (width, height), the canvas' corner in it with the box's centre in the middle, and what of the scaled image it shows."""
    whole = lambda c: F.bround(c).cast("long")
    (w, h), (cw, ch) = image, canvas
    scale = F.lit(share * ch) / F.greatest(F.lit(1.0), (b[3] - b[1]).cast("double"))
    new_w, new_h = F.greatest(F.lit(1).cast("long"), whole(F.lit(float(w)) * scale)), F.greatest(F.lit(1).cast("long"), whole(F.lit(float(h)) * scale))
    cx, cy = centre(b)
    left, top = whole(cx * scale - F.lit(cw / 2.0)), whole(cy * scale - F.lit(ch / 2.0))
    zero = F.lit(0).cast("long")
    return [scale, new_w, new_h, left, top, F.greatest(zero, left), F.greatest(zero, top), F.least(new_w, left + cw), F.least(new_h, top + ch)]
