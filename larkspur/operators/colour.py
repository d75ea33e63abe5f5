"""Colours of image bytes: exact sums over painted pixels per picture, which Spark adds up, and the match they define.

Channels are L*a*b* on a scale of 255, rounded to whole numbers, so sums are whole and the same in whatever order they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masks
from ..functions.runs import by_steps, flat

CHANNELS = ("l", "a", "b")
MOMENTS = "struct<n:bigint,l:bigint,a:bigint,b:bigint,ll:bigint,aa:bigint,bb:bigint>"


_TABLE: list[np.ndarray] = []  # of a worker, made when it meets its first colour


def _pixels(rgb: np.ndarray) -> np.ndarray:
    """L*a*b* bytes of (n, 3) bytes of RGB. A worker turns a colour once and looks it up from then on, in 64 MB at most."""
    if not _TABLE:
        _TABLE.append(np.zeros(1 << 24, "<u4"))
    table = _TABLE[0]
    code = np.ndarray((len(rgb),), "<u4", np.append(rgb, np.uint8(0)), 0, (3,)) & 0xFFFFFF  # each pixel's three bytes and one more
    got = table[code]
    if not got.all():
        new = np.unique(code[got == 0])
        lab = np.clip(np.rint(masks.lab(np.stack([new & 255, new >> 8 & 255, new >> 16], axis=1))), 0, 255).astype(np.uint32)
        table[new] = lab[:, 0] | lab[:, 1] << 8 | lab[:, 2] << 16 | 1 << 24  # a zero was not met yet
        got = table[code]
    out = np.empty((len(rgb), 3), np.uint8)
    for i in range(3):
        out[:, i] = got.view(np.uint8)[i::4]
    return out


def _painted(rgb: pa.Array, mask: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(some, pixels, n, at) of pictures: which have pixels and a mask, and of those all pixels, how many each has, and the places of the painted ones."""
    some = pc.and_(rgb.is_valid(), mask.is_valid())
    (data, sizes), (on, n) = (flat(c.filter(some)) for c in (rgb, mask))
    if (sizes != 3 * n).any():
        raise ValueError("a picture has three bytes for each byte of its mask")
    return some.to_numpy(zero_copy_only=False), data.reshape(-1, 3), n, np.flatnonzero(on)


def _moments(rgb: pa.Array, mask: pa.Array, width: pa.Array) -> pa.Array:
    """Painted pixels alone are turned to colours, those of all pictures given at once."""
    some, data, n, at = _painted(rgb, mask)
    x = _pixels(data[at]).astype(np.int64)
    sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(np.concatenate([x, x * x], axis=1), axis=0)])
    ends = np.searchsorted(at, np.concatenate([[0], np.cumsum(n)]))
    of = np.zeros((len(some), 7), np.int64)
    of[some] = np.concatenate([np.diff(ends)[:, None], sums[ends[1:]] - sums[ends[:-1]]], axis=1)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in of.T], names=["n", *CHANNELS, "ll", "aa", "bb"], mask=pa.array(~some))


def moments(rgb: Column, mask: Column, width: Column) -> Column:
    """Count, sums and sums of squares of a picture's channels where its mask (a byte per pixel) isn't zero; null without either."""
    return F.arrow_udf(by_steps(_moments), MOMENTS)(rgb, mask, width)


def stats(pictures: DataFrame, by: list[str], of: str = "moments") -> DataFrame:
    """by, n, and mean and population spread of each channel over the pixels of all pictures; null if there are none."""
    sums = pictures.groupBy(*by).agg(*[F.sum(f"{of}.{c}").alias(c) for c in ("n", *CHANNELS, "ll", "aa", "bb")])
    big = lambda c: F.col(c).cast("decimal(25,0)").cast("decimal(38,0)")
    some = F.col("n") > 0
    out = []
    for c in CHANNELS:
        spread = F.sqrt((big("n") * F.col(c * 2) - big(c) * F.col(c)).cast("double")) / F.col("n")
        out += [F.when(some, F.col(c) / F.col("n")).alias(f"{c}_mean"), F.when(some, spread).alias(f"{c}_std")]
    return sums.select(*by, F.coalesce("n", F.lit(0)).alias("n"), *out)


def chroma(a_mean: Column, b_mean: Column) -> Column:
    return F.sqrt(F.pow(a_mean - 128, 2) + F.pow(b_mean - 128, 2))


def _box(height: pa.Array, width: pa.Array) -> pa.Array:
    out = []
    for h, w in zip(height.to_pylist(), width.to_pylist(), strict=True):
        on = np.zeros((h, w), np.uint8)
        on[h * 30 // 100 : h * 95 // 100, w * 20 // 100 : w * 80 // 100] = 1
        out.append(on.tobytes())
    return pa.array(out, pa.binary())


def middle(height: Column, width: Column) -> Column:
    """A mask of where a reference picture shows its subject: rows from 30 to 95 in a hundred, columns from 20 to 80."""
    return F.arrow_udf(by_steps(_box), "binary")(height, width)


def _six(stats: pa.Array) -> np.ndarray:
    """(n, 6) of arrays of six; not a number where an array or one of its values is null."""
    out = np.full((len(stats), 6), np.nan)
    out[stats.is_valid().to_numpy(zero_copy_only=False)] = stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, 6)
    return out


def _matched(rgb: pa.Array, mask: pa.Array, width: pa.Array, own: pa.Array, to: pa.Array, chroma_only: bool) -> pa.Array:
    """A painted pixel goes where its picture's means and spreads move its byte of each channel: 256 values are moved once for all pictures that share them."""
    some, data, n, at = _painted(rgb, mask)
    kinds, kind = np.unique(np.concatenate([_six(own), _six(to)], axis=1)[some].view("V96").ravel(), return_inverse=True)
    moved = np.empty((len(kinds), 256, 3), np.uint8)
    for i, v in enumerate(np.frombuffer(kinds.tobytes()).reshape(-1, 4, 3)):
        x = np.repeat(np.arange(256.0)[:, None], 3, axis=1)
        moved[i] = x if np.isnan(v).any() else np.clip(np.round(masks.match_colour(x, *v, chroma_only), 6), 0, 255)
    out = _pixels(data)
    out[at] = moved[np.repeat(kind, n)[at][:, None], out[at], np.arange(3)]
    sizes = np.zeros(len(some), np.int64)
    sizes[some] = 3 * n
    gone = pa.py_buffer(np.packbits(some, bitorder="little")) if not some.all() else None
    return pa.Array.from_buffers(pa.binary(), len(some), [gone, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(out)])


def matched(rgb: Column, mask: Column, width: Column, own: Column, to: Column, chroma_only: bool = False) -> Column:
    """L*a*b* bytes of a picture whose painted pixels are moved from their own means and spreads (array of six) to others; null moves nothing, a null picture or mask gives null.

    Parts of whole numbers are cut off, but a millionth under one is one.
    """
    call = lambda a, b, c, d, e: _matched(a, b, c, d, e, chroma_only)
    return F.arrow_udf(by_steps(call), "binary")(rgb, mask, width, own, to)


def six(prefix: str = "") -> Column:
    """Means and spreads of stats() as the array that matched() takes."""
    return F.array(*[F.col(f"{prefix}{c}_{k}") for k in ("mean", "std") for c in CHANNELS])
