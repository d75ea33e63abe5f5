"""Rows against a gallery as matrix products: an Arrow batch of vectors times a block of identities.

A gallery whose size is checked to be under ``BROADCAST`` bytes goes to all tasks and nothing of the rows is shuffled. A larger
one comes in blocks: rows are dealt to slabs that fit a task, every slab gets each block once, in order, and holds one at a
time. Either way a row meets all identities in one task, so what it keeps of them (two numbers, say) needs no merging.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

BROADCAST = 64 << 20  # bytes of a gallery that all tasks may hold
SLAB = 64 << 20  # bytes of the rows that meet a larger one in a task
BLOCK = 4096  # identities of a block
_DIGITS = 12  # cosines that agree so far are equal, whatever order a product was summed in

#: Takes the rows of a batch (all columns but the vector), and gives what to do with a block (gids, cosines by row and identity) and the result.
Fold = Callable[[pa.RecordBatch], tuple[Callable[[np.ndarray, np.ndarray], None], Callable[[], Iterator[pa.RecordBatch]]]]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Doubles by row; a null vector, or one of another length, is all NaN, so it is like nobody."""
    sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    good = sizes == dim
    out = np.full((len(vectors), dim), np.nan)
    flat = vectors.filter(pa.array(good)).flatten().cast(pa.float64())
    out[good] = flat.to_numpy(zero_copy_only=False).reshape(int(good.sum()), dim)
    return out


def against(rows: DataFrame, gallery: DataFrame, vector: str, fold: Fold, schema: str, broadcast: int = BROADCAST, slab: int = SLAB, block: int = BLOCK) -> DataFrame:
    """What ``fold`` makes of the cosines of rows with gallery(gid, centroid), both unit vectors. Identities come by gid."""
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != vector]
    about = gallery.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("dim")).first()
    n, dim = about["n"], about["dim"] or 0
    known = gallery.where(F.size("centroid") == dim).select(F.col("gid").cast("long").alias("gid"), F.col("centroid").cast("array<double>").alias("centroid"))
    if n * dim * 8 <= broadcast:
        held = sorted((r["gid"], r["centroid"]) for r in known.collect())
        sent = spark.sparkContext.broadcast((np.array([g for g, _ in held], np.int64), np.array([c for _, c in held], float).reshape(len(held), dim)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gids, centroids = sent.value
            for batch in batches:
                add, done = fold(batch.select(others))
                v = _matrix(batch.column(vector), dim)
                for at in range(0, len(gids), block):
                    add(gids[at : at + block], np.round(v @ centroids[at : at + block].T, _DIGITS))
                yield from done()

        return rows.select(*others, vector).mapInArrow(work, schema)

    table = scratch.written(rows.select(*others, F.col(vector).cast("array<double>").alias(vector)), "queries")
    slabs = max(1, -(-table.count() * dim * 8 // slab))
    mine = table.select(F.pmod(F.monotonically_increasing_id(), F.lit(slabs)).cast("int").alias("__slab"), F.lit(-1).cast("long").alias("__block"), F.struct(*others).alias("__row"), F.col(vector).alias("__v"), F.lit(None).cast("long").alias("__gid"))
    ranked = scratch.written(known.repartitionByRange(max(1, n // (16 * block)), "gid").sortWithinPartitions("gid"), "identities")
    theirs = ranked.select(F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("__slab"), F.col("gid").alias("__block"), F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), F.col("centroid").alias("__v"), F.col("gid").alias("__gid"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state = None, [], None
        gids: list[np.ndarray] = []
        centroids: list[np.ndarray] = []

        def begin() -> tuple:
            whole = pa.Table.from_batches(held).combine_chunks()
            row = whole["__row"].combine_chunks()
            row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
            add, done = fold(pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in row.type]))
            v = whole["__v"].combine_chunks()
            return add, done, _matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v, dim)

        def flush() -> None:
            if gids and state:
                state[0](np.concatenate(gids), np.round(state[2] @ np.concatenate(centroids).T, _DIGITS))
            gids.clear()
            centroids.clear()

        def end() -> Iterator[pa.RecordBatch]:
            flush()
            if state or held:
                yield from (state or begin())[1]()

        for batch in batches:
            slab_of, is_row = batch.column("__slab").to_numpy(), batch.column("__gid").is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(slab_of) != 0) | (np.diff(is_row.astype(int)) != 0)) + 1).tolist(), len(slab_of)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if slab_of[lo] != at:
                    yield from end()
                    at, held, state = slab_of[lo], [], None
                part = batch.slice(lo, hi - lo)
                if is_row[lo]:
                    held.append(part)
                elif held or state:
                    if state is None:
                        state, held = begin(), []
                    gids.append(part.column("__gid").to_numpy())
                    centroids.append(_matrix(part.column("__v"), dim))
                    if sum(map(len, gids)) >= block:
                        flush()
        yield from end()

    return mine.unionByName(theirs).repartition(slabs, "__slab").sortWithinPartitions("__slab", "__block").mapInArrow(stream, schema)


def _top_two(keys: list[str]) -> Fold:
    def fold(rows: pa.RecordBatch):
        n = rows.num_rows
        first, second, gid = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        seen = 0

        def add(gids: np.ndarray, cos: np.ndarray) -> None:
            nonlocal first, second, gid, seen
            seen += len(gids)
            cos = np.where(np.isnan(cos), -np.inf, cos)
            at = cos.argmax(axis=1)  # the first of equals, which has the lowest gid
            best = cos[np.arange(n), at]
            cos[np.arange(n), at] = -np.inf
            runner = cos.max(axis=1)
            better = best > first
            second = np.where(better, np.maximum(first, runner), np.maximum(second, best))
            first, gid = np.where(better, best, first), np.where(better, gids[at], gid)

        def done() -> Iterator[pa.RecordBatch]:
            none = ~np.isfinite(first)
            cols = [pa.array(gid, mask=none), pa.array(first, mask=none), pa.array(second, mask=~np.isfinite(second)), pa.array(np.full(n, seen, np.int64))]
            yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in keys], *cols], names=[*keys, "gid", "assigned_sim", "second_best_sim", "n_identities"])

        return add, done

    return fold


def top_two(rows: DataFrame, gallery: DataFrame, vector: str, keys: list[str], **sizes: int) -> DataFrame:
    """(keys, gid, assigned_sim, second_best_sim, n_identities) of each row: ties go to the lower gid, the second is null if there is none.

    Rows without a vector of the gallery's length are like nobody: gid and both similarities are null, as in an empty gallery.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "gid long, assigned_sim double, second_best_sim double, n_identities long"])
    return against(rows.select(*keys, vector), gallery, vector, _top_two(keys), schema, **sizes)


def _all(keys: list[str]) -> Fold:
    def fold(rows: pa.RecordBatch):
        parts: list[pa.RecordBatch] = []

        def add(gids: np.ndarray, cos: np.ndarray) -> None:
            r, c = np.nonzero(~np.isnan(cos))
            parts.append(pa.RecordBatch.from_arrays([*[rows.column(k).take(pa.array(r)) for k in keys], pa.array(gids[c]), pa.array(cos[r, c])], names=[*keys, "gid", "cos"]))

        return add, lambda: iter(parts)

    return fold


def similarities(rows: DataFrame, gallery: DataFrame, vector: str, keys: list[str], **sizes: int) -> DataFrame:
    """(keys, gid, cos): a row for each row and identity."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "gid long, cos double"])
    return against(rows.select(*keys, vector), gallery, vector, _all(keys), schema, **sizes)


def _winners(key: str) -> Fold:
    def fold(rows: pa.RecordBatch):
        ids = rows.column(key).to_numpy(zero_copy_only=False)
        parts: list[pa.RecordBatch] = []

        def add(gids: np.ndarray, cos: np.ndarray) -> None:
            if not len(ids):
                return
            cos = np.where(np.isnan(cos), -np.inf, cos)
            best = cos.max(axis=0)
            is_best = cos == best
            lowest = np.where(is_best, ids[:, None], np.iinfo(np.int64).max).min(axis=0)
            n = np.isfinite(best)
            parts.append(pa.RecordBatch.from_arrays([pa.array(gids[n]), pa.array(best[n]), pa.array(lowest[n]), pa.array(is_best.sum(axis=0)[n])], names=["gid", "best", "winner", "n"]))

        return add, lambda: iter(parts)

    return fold


def column_winners(rows: DataFrame, gallery: DataFrame, vector: str, key: str, **sizes: int) -> DataFrame:
    """(gid, best, winner): the row (a whole number) of strictly highest cosine with each identity; no winner on a tie.

    Every batch gives its best of an identity and how many share it; those meet by gid after a partial aggregate.
    """
    parts = against(rows.select(F.col(key).cast("long").alias(key), vector), gallery, vector, _winners(key), "gid long, best double, winner long, n long", **sizes)
    top = parts.groupBy("gid").agg(F.max(F.struct("best", (-F.col("winner")).alias("neg"), "n")).alias("hi"), F.max(F.struct("best", "winner")).alias("lo"))
    lone = (-F.col("hi.neg") == F.col("lo.winner")) & (F.col("hi.n") == 1)
    return top.select("gid", F.col("hi.best").alias("best"), F.when(lone, F.col("lo.winner")).alias("winner"))
