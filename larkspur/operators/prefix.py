"""As-of values, streaks and running vector sums whose keys may be longer than a task: order is cut into stretches.

A stretch holds the rows of a key from ``k * width`` to the next. Rows are dealt by key and stretch, so one very long video
is many tasks; what a stretch hands on (its last value, the streak at its end, its sum) is one row, and those rows, one for
``width`` places, run through a window and come back by key and stretch. ``order`` is a number that no two rows of a key
share; null keys make a key of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

WIDTH = 4096


def _stretch(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).cast("long")


def _back(rows: DataFrame, handed: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what their stretch was handed; null keys meet too."""
    renamed = handed.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate((*keys, "__stretch"))], "__in")
    same = [rows[c].eqNullSafe(renamed[f"__k{i}"]) for i, c in enumerate((*keys, "__stretch"))]
    return rows.join(renamed, same, "left").drop(*[f"__k{i}" for i in range(len(keys) + 1)])


def last_value(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, own: bool = False, width: int = WIDTH) -> DataFrame:
    """rows and ``name``: the last value before each row (``own``: or of the row itself) that is not null."""
    cut = rows.withColumns({"__stretch": _stretch(order, width), "__value": value})
    last = F.max(F.when(F.col("__value").isNotNull(), F.struct(F.col(order).alias("at"), F.col("__value").alias("value")))).alias("last")
    ends = cut.groupBy(*keys, "__stretch").agg(last)
    before = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.withColumn("__in", F.last("last", ignorenulls=True).over(before)["value"]).where("__in is not null")
    here = Window.partitionBy(*keys, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    met = _back(cut, handed, keys).withColumn(name, F.coalesce(F.last("__value", ignorenulls=True).over(here), F.col("__in")))
    return met.drop("__stretch", "__value", "__in")


def streak(rows: DataFrame, keys: list[str], order: str, bad: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows and ``name`` (long): how many rows in a row were bad up to each; one that isn't bad, or null, ends it."""
    here = Window.partitionBy(*keys, "__stretch").orderBy(order)
    cut = rows.withColumns({"__stretch": _stretch(order, width), "__bad": F.coalesce(bad, F.lit(False))})
    cut = cut.withColumn("__good", F.sum((~F.col("__bad")).cast("long")).over(here))
    own = Window.partitionBy(*keys, "__stretch", "__good").orderBy(order)
    cut = cut.withColumn("__own", F.sum(F.col("__bad").cast("long")).over(own))
    ends = cut.groupBy(*keys, "__stretch").agg(F.max_by("__own", order).alias("tail"), F.max("__good").alias("good"))
    stretches = Window.partitionBy(*keys).orderBy("__stretch")
    ends = ends.withColumn("since", F.sum((F.col("good") > 0).cast("long")).over(stretches))
    ends = ends.withColumn("out", F.sum("tail").over(Window.partitionBy(*keys, "since").orderBy("__stretch")))
    handed = ends.withColumn("__in", F.lag("out").over(stretches)).where("__in > 0")
    more = F.when(F.col("__good") == 0, F.coalesce("__in", F.lit(0))).otherwise(0)
    return _back(cut, handed, keys).withColumn(name, F.col("__own") + more).drop("__stretch", "__bad", "__good", "__own", "__in")


def _groups(columns: list[pa.Array]) -> np.ndarray:
    """Where rows start that differ from the row before in one of the columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of doubles, their lengths): shorter vectors and null entries count as zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1), sizes
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _wider(v: np.ndarray, d: int) -> np.ndarray:
    return v if len(v) >= d else np.pad(v, (0, d - len(v)))


def _per_stretch(batches: Iterator[pa.RecordBatch], n_keys: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(keys, stretch, sum, n) of each stretch; rows (keys, stretch, order, w, v, ...) come in order, over several batches too."""
    held: tuple | None = None

    def done(keys: list, total: np.ndarray, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*keys, pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i) for i in range(n_keys + 1)]
        v, _ = _matrix(batch.column(n_keys + 2))
        w = batch.column(n_keys + 1).to_numpy(zero_copy_only=False)
        starts = _groups(keys)
        sums, counts = np.add.reduceat(v * w[:, None], starts), np.add.reduceat((w > 0).astype(np.int64), starts)
        for i, s in enumerate(starts.tolist()):
            own = [k.slice(s, 1) for k in keys]
            if i == 0 and held is not None and all(a.equals(b) for a, b in zip(held[0], own, strict=True)):
                d = max(len(held[1]), v.shape[1])
                held = (own, _wider(held[1], d) + _wider(sums[0], d), held[2] + int(counts[0]))
                continue
            if held is not None:
                yield done(*held)
            held = (own, sums[i], int(counts[i]))
    if held is not None:
        yield done(*held)


def running_means(rows: DataFrame, keys: list[str], order: str, vector: str, weight: Column, before: bool = False, width: int = WIDTH) -> DataFrame:
    """(keys, order, running, n): the unit mean of the weighted vectors so far (``before``: without the row's own), null if none has weight.

    Whole vectors are summed in Arrow batches, a stretch at a time; a stretch starts with the sum it is handed. Rows without a
    vector have no row; null entries and missing ones of shorter vectors count as zero.
    """
    cut = rows.where(F.size(vector) > 0).select(*keys, _stretch(order, width).alias("__stretch"), F.coalesce(weight.cast("double"), F.lit(0.0)).alias("__w"), F.col(vector).cast("array<double>").alias("__v"), order)
    cut = scratch.written(cut.repartition(*keys, "__stretch").sortWithinPartitions(*keys, "__stretch", order), "stretches")
    spans = cut.groupBy(*keys).agg(F.min("__stretch").alias("a"), F.max("__stretch").alias("z")).where("a < z")
    dealt = cut.repartition(*keys, "__stretch")
    n_keys, fields = len(keys), {f.name: f for f in cut.schema.fields}
    handed = None
    if not spans.isEmpty():  # else no sum is handed on
        type_of = lambda c: f"{c} {fields[c].dataType.simpleString()}"
        names = [*keys, "__stretch", "s", "n"]
        sums = dealt.sortWithinPartitions(*keys, "__stretch").mapInArrow(lambda b: _per_stretch(b, n_keys, names), ", ".join([*map(type_of, (*keys, "__stretch")), "s array<double>", "n long"]))
        handed = scratch.written(_handed(sums, keys), "handed")
    first = F.row_number().over(Window.partitionBy(*keys, "__stretch").orderBy(order)) == 1
    if handed is not None:
        at = _back(dealt.withColumn("__first", first), handed, keys).withColumn("__in", F.when(F.col("__first"), F.col("__in"))).drop("__first")
    else:
        at = dealt.withColumn("__in", F.lit(None).cast("struct<s:array<double>,n:bigint>"))
    ordered = at.select(*keys, "__stretch", order, "__w", "__v", "__in.s", "__in.n").sortWithinPartitions(*keys, "__stretch", order)
    out = ", ".join([*[f"{c} {fields[c].dataType.simpleString()}" for c in (*keys, order)], "running array<double>", "n long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, seen = None, np.zeros(0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys_of = [batch.column(i) for i in range(n_keys + 1)]
            v, sizes = _matrix(batch.column(n_keys + 3))
            w = batch.column(n_keys + 2).to_numpy(zero_copy_only=False)
            starts = _groups(keys_of)
            v, full, n = v * w[:, None], np.zeros(v.shape), np.zeros(len(w), np.int64)
            ends = np.append(starts[1:], len(w))
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                own = [k.slice(s, 1) for k in keys_of]
                if at is None or not all(a.equals(b) for a, b in zip(at, own, strict=True)):
                    given = batch.column(n_keys + 4)[s].as_py()
                    at, total, seen = own, np.array(given if given is not None else [], float), batch.column(n_keys + 5)[s].as_py() or 0
                d = max(len(total), v.shape[1])
                if d > full.shape[1]:
                    v, full = np.pad(v, ((0, 0), (0, d - v.shape[1]))), np.pad(full, ((0, 0), (0, d - full.shape[1])))
                sums = np.cumsum(np.concatenate([_wider(total, d)[None], v[s:e]]), axis=0)
                counts = seen + np.concatenate([[0], np.cumsum(w[s:e] > 0)])
                full[s:e, :d], n[s:e] = (sums[:-1], counts[:-1]) if before else (sums[1:], counts[1:])
                total, seen = sums[-1], int(counts[-1])
            inside = np.arange(full.shape[1]) < sizes[:, None]
            full[~inside] = 0
            full /= np.maximum(np.sqrt(np.square(full).sum(axis=1)), 1e-12)[:, None]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            running = pa.ListArray.from_arrays(pa.array(offsets), pa.array(full[inside]), mask=pa.array(n == 0))
            yield pa.RecordBatch.from_arrays([*keys_of[:n_keys], batch.column(n_keys + 1), running, pa.array(n)], names=[f.split(" ")[0] for f in out.split(", ")])

    return ordered.mapInArrow(work, out)


def _handed(sums: DataFrame, keys: list[str]) -> DataFrame:
    """What each stretch is handed: the sum of those before it, added up in a window over one row a stretch and dimension."""
    flat = sums.select(*keys, "__stretch", "n", F.posexplode("s").alias("i", "x"))
    before = Window.partitionBy(*keys, "i").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    so_far = flat.withColumns({"x": F.sum("x").over(before), "n": F.sum("n").over(before)}).where("x is not null")
    whole = so_far.groupBy(*keys, "__stretch").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"), F.max("n").alias("n"))
    return whole.select(*keys, "__stretch", F.struct(F.transform("s", lambda p: p["x"]).alias("s"), "n").alias("__in"))
