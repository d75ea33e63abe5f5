"""Run-length masks of whole Arrow batches: intervals and the printable code from one flat buffer, no loop over rows.

A mask is an array of run lengths, column by column, the first of zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 512  # rows of a batch that are worked on together: what an image kernel holds follows from it, not from the batch


def by_steps(f, step: int = STEP):
    """f over slices of its arrays, put together again."""

    def call(*columns: pa.Array) -> pa.Array:
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        parts = [f(*(c.slice(at, step) for c in columns)) for at in range(0, max(1, len(columns[0])), step)]
        return pa.concat_arrays(parts)

    return call


def flat(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of each) of binary values, none of them null, one after the other."""
    if not len(data):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


_SEGMENT = pa.struct([("x", pa.int32()), ("y0", pa.int32()), ("y1", pa.int32())])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, row of each, place in its row) of a column of arrays; null and empty arrays have none."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().cast(pa.int64()).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), sizes)
    return values, rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _offsets(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)


def _lists(values: pa.Array, rows: np.ndarray, like: pa.Array) -> pa.Array:
    """values as arrays by row; null where ``like`` is."""
    gone = like.is_null()
    return pa.ListArray.from_arrays(pa.array(_offsets(rows, len(like))), values, mask=gone if gone.true_count else None)


def _within(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Running sums that start anew with each row."""
    total = np.cumsum(values)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return total - np.repeat(total[first] - values[first], np.diff(np.append(first, len(rows))))


def stretches(lists: pa.Array, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y0, y1) of the ones of each mask in image columns, y1 excluded, in order."""
    rows, a, z = _places(lists)
    n = (z - 1) // height - a // height + 1
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    last = k == np.repeat(n, n) - 1
    a, z, rows = np.repeat(a, n), np.repeat(z, n), np.repeat(rows, n)
    return rows, a // height + k, np.where(k == 0, a % height, 0), np.where(last, (z - 1) % height + 1, height)


def cut(runs: pa.Array, height: int) -> pa.Array:
    """The ones of each mask as segments (x, y0, y1) of image columns, y1 excluded, in order."""
    rows, *parts = stretches(runs, height)
    return _lists(pa.StructArray.from_arrays([pa.array(p, pa.int32()) for p in parts], fields=list(_SEGMENT)), rows, runs)


_ONES = np.array([(1 << i) - 1 for i in range(65)], np.uint64)


def between(y0: np.ndarray, y1: np.ndarray, height: int) -> np.ndarray:
    """(n, words) of 64 bits: of a column of this height the places from y0 to before y1."""
    at = np.arange(0, height, 64)
    return _ONES[np.clip(y1[:, None] - at, 0, 64)] ^ _ONES[np.clip(y0[:, None] - at, 0, 64)]


def bits(lists: pa.Array, height: int, width: int) -> np.ndarray:
    """(mask, image column, words) of 64 bits each: the ones of masks, none of a null one."""
    rows, x, y0, y1 = stretches(lists, height)
    out = np.zeros((len(lists) * width, (height + 63) // 64), np.uint64)
    at = rows * width + x
    first = np.flatnonzero(np.diff(at, prepend=-1))
    if len(first):
        out[at[first]] = np.bitwise_or.reduceat(between(y0, y1, height), first, axis=0)
    return out.reshape(len(lists), width, -1)


def encoded(runs: pa.Array) -> pa.Array:
    """The printable code of the COCO annotation format: each length from the third on as the difference to the one two before
    it, in groups of five bits, lowest first; 32 marks that more follow, and the last group carries the sign."""
    values, rows, at = _flat(runs)
    x = values.copy()
    later = np.flatnonzero(at > 2)
    x[later] -= values[later - 2]
    groups = 1 + sum(((x >= 1 << (5 * k - 1)) | (x < -(1 << (5 * k - 1)))).astype(np.int64) for k in range(1, 13))
    j = np.arange(int(groups.max(initial=1)))
    chars = ((x[:, None] >> (5 * j)) & 31) + np.where(j < groups[:, None] - 1, 32, 0) + 48
    data = chars[j < groups[:, None]].astype(np.uint8)
    sizes = np.bincount(rows, weights=groups, minlength=len(runs)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    out = pa.StringArray.from_buffers(len(runs), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return pc.if_else(runs.is_null(), pa.scalar(None, pa.string()), out)


def decoded(codes: pa.Array) -> pa.Array:
    """Run lengths from their printable code."""
    texts = codes.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int64) - 48
    rows = np.repeat(np.arange(len(codes)), np.diff(offsets))
    end = data & 32 == 0
    first = np.flatnonzero(np.concatenate([[True], end[:-1]])) if len(data) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(data)))
    place = np.arange(len(data)) - np.repeat(first, sizes)
    x = np.add.reduceat((data & 31) << (5 * place), first) if len(first) else np.empty(0, np.int64)
    x = np.where(data[end] & 16, x - (1 << (5 * sizes)), x)
    rows = rows[end]
    at = np.arange(len(x)) - np.repeat(np.cumsum(n := np.bincount(rows, minlength=len(codes))) - n, n)
    for odd in (0, 1):  # from the third on, lengths of ones and of zeros are sums of their own differences
        some = np.flatnonzero((at % 2 == odd) & (at > 0))
        if len(some):
            x[some] = _within(x[some], rows[some])
    return _lists(pa.array(x, pa.int32()), rows, codes)


def segments(runs: Column, height: int) -> Column:
    """array<struct<x, y0, y1>>: the ones of a mask of this height by image column; null of null."""
    return F.arrow_udf(by_steps(lambda a: cut(a, height)), "array<struct<x:int,y0:int,y1:int>>")(runs)


def code(runs: Column) -> Column:
    return F.arrow_udf(by_steps(encoded), "string")(runs)


def from_code(codes: Column) -> Column:
    return F.arrow_udf(by_steps(decoded), "array<int>")(codes)


def lengths(rows: np.ndarray, a: np.ndarray, z: np.ndarray, like: pa.Array, total: int) -> pa.Array:
    """Run lengths of masks of ``total`` pixels from their stretches of ones [a, z), ordered by row and place; those that touch are one."""
    n, first = len(like), np.diff(rows, prepend=-1) != 0
    new = first | (a != np.concatenate([[-1], z[:-1]]))
    rows, a, z = rows[new], a[new], z[np.append(np.flatnonzero(new)[1:] - 1, len(z) - 1)] if len(z) else z
    before = np.where(np.diff(rows, prepend=-1) != 0, 0, np.concatenate([[0], z[:-1]]))
    last = np.zeros(n, np.int64)
    last[rows] = z  # the last one of a row stays
    tail = np.flatnonzero(last < total)
    of = np.concatenate([np.repeat(rows, 2), tail])
    values = np.concatenate([np.stack([a - before, z - a], axis=1).ravel(), (total - last)[tail]])
    order = np.argsort(of, kind="stable")
    keep = order[~like.is_null().to_numpy(zero_copy_only=False)[of[order]]]
    return _lists(pa.array(values[keep], pa.int32()), of[keep], like)


def joined(segs: pa.Array, height: int, width: int) -> pa.Array:
    """Run lengths of lists of ordered segments: what cut() gives, back."""
    sizes = pc.list_value_length(segs).fill_null(0).to_numpy(zero_copy_only=False)
    x, y0, y1 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in segs.flatten().flatten())
    return lengths(np.repeat(np.arange(len(segs)), sizes), x * height + y0, x * height + y1, segs, height * width)


def of_segments(segs: Column, height: int, width: int) -> Column:
    return F.arrow_udf(by_steps(lambda a: joined(a, height, width)), "array<int>")(segs)


def ones(runs: pa.Array) -> pa.Array:
    values, rows, at = _flat(runs)
    n = np.bincount(rows, weights=values * (at % 2), minlength=len(runs)).astype(np.int64)
    return pa.array(n, mask=runs.is_null().to_numpy(zero_copy_only=False))


def area(runs: Column) -> Column:
    return F.arrow_udf(by_steps(ones), "long")(runs)


def _places(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, z) of the stretches of ones of each mask, column by column, z excluded."""
    values, rows, at = _flat(lists)
    ends = _within(values, rows) if len(values) else values
    ones = (at % 2 == 1) & (values > 0)
    return rows[ones], (ends - values)[ones], ends[ones]


def pixels(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each one of each mask; places count column by column."""
    rows, a, z = _places(lists)
    n = z - a
    return np.repeat(rows, n), np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _on(lists: pa.Array, xs: pa.Array, ys: pa.Array, grown: int, height: int, width: int) -> pa.Array:
    half = [round(max(grown * grown - dy * dy, 0) ** 0.5) for dy in range(grown + 1)]
    of, a, z = _places(lists)
    size = height * width
    a, z = of * size + a, of * size + z
    x, rows, _ = _flat(xs)
    y = _flat(ys)[0]
    inside = (x >= 0) & (y >= 0) & (x < width) & (y < height) & (np.bincount(of, minlength=len(lists))[rows] > 0)
    hit = np.zeros(len(x), bool)
    for dx in range(-grown, grown + 1):
        dy = max(d for d, w in enumerate(half) if w >= abs(dx))
        some = np.flatnonzero(inside & ~hit & (x + dx >= 0) & (x + dx < width))
        column = rows[some] * size + (x[some] + dx) * height
        lo, hi = column + np.maximum(y[some] - dy, 0), column + np.minimum(y[some] + dy, height - 1)
        last = np.searchsorted(a, hi, "right") - 1  # stretches are in order and apart, so the last to start reaches farthest
        hit[some] = (last >= 0) & (z[last] > lo)
    return _lists(pa.array(hit), rows, xs)


def on(mask: Column, xs: Column, ys: Column, grown: int, size: tuple[int, int]) -> Column:
    """array<boolean>: which points (arrays x and y of whole numbers) are on a mask grown by an ellipse of ``grown`` pixels; none outside the image or on a null mask."""
    return F.arrow_udf(by_steps(lambda m, x, y: _on(m, x, y, grown, *size)), "array<boolean>")(mask, xs, ys)
