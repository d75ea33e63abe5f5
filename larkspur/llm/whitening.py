"""Whitening of embeddings: leading components of their covariance by LOBPCG over distributed products, certified, then applied."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared, written

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000


@dataclass(frozen=True)
class Params:
    """components: at most so many, of non-zero variance. guard: more columns of the blocks, which make the wanted ones converge
    faster. tolerance: largest residual norm over the largest eigenvalue. rounds: more than that raise an error."""

    components: int = 8
    guard: int = 16
    tolerance: float = 1e-13
    rounds: int = 300
    seed: int = 1


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows whose vector is there, of full length and finite, with whole numbers instead of its entries."""
    far = F.lit(1 << 62)
    x = F.transform("v", lambda c: F.greatest(F.least(F.floor(c * SCALE), far), -far) + SHIFT)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("v").isNotNull() & ~bad).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sum(table: DataFrame, size: int, of_batch) -> np.ndarray:
    """The sum over all rows of a vector of ``size`` doubles, added up by task, then by position in Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

    out = np.zeros(size)
    for row in table.select("x").mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[row["at"]] = row["v"]
    return out


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of block span beyond those of against; dependent columns are left out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 1e-10] / norms[norms > 1e-10]
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8 * s[0]]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


@dataclass(frozen=True)
class Fit:
    """n rows, S their sums by dimension, components in columns, eigenvalues, the trace, and the residuals that certify them."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray


def lobpcg(product, dim: int, wanted: int, params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, residual norms) of the ``wanted`` largest of a symmetric matrix known by its products with blocks.

    Each round multiplies one block, the residuals of the iterate, and solves the problem on the span of iterate, residuals
    and previous directions (Rayleigh-Ritz). Bases are kept orthonormal, so products of iterate and directions can be carried
    along; the final residuals come from a fresh product.
    """
    width = min(dim, wanted + params.guard)
    rng = np.random.default_rng(params.seed)
    x = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    ax = product(x)
    p = ap = np.empty((dim, 0))
    fresh = True
    for _ in range(params.rounds):
        values, c = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, c = values[::-1], c[:, ::-1]
        x, ax = x @ c, ax @ c
        rest = ax - x * values
        norms = np.linalg.norm(rest, axis=0)[:wanted]
        done = bool((norms <= params.tolerance * max(values[0], 0.0)).all())
        if done and fresh:
            return values[:wanted], x[:, :wanted], norms
        basis = np.hstack([x, p])
        w = np.empty((dim, 0)) if done else _orthonormal(rest, basis)
        if done or not w.shape[1]:  # the carried products are checked by new ones, after which the iteration goes on if need be
            x = np.linalg.qr(x)[0]
            ax, p, ap, fresh = product(x), np.empty((dim, 0)), np.empty((dim, 0)), True
            continue
        aw, fresh = product(w), False
        basis, image = np.hstack([x, p, w]), np.hstack([ax, ap, aw])
        gram = basis.T @ image
        c = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1][:, :width]
        step = c.copy()
        step[:width] = 0
        step = _orthonormal(step, c)
        x, ax, p, ap = basis @ c, image @ c, basis @ step, image @ step
    raise ValueError(f"residuals of {norms.max() / values[0]:.1e} of the largest eigenvalue after {params.rounds} rounds")


def fit(table: DataFrame, dim: int, params: Params = Params()) -> Fit:
    """Components of the covariance of table(x), all of whose arrays have ``dim`` entries. Only blocks of dim rows reach the driver."""
    spark = table.sparkSession
    sums = {r["at"]: int(r["s"]) for r in table.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
    n = table.count()
    total = np.array([sums[i] for i in range(dim)], object)
    # x - S/n without loss: whole parts are subtracted as integers, what is left of S/n is below one.
    whole, left = np.array([s // n for s in total], np.int64), np.array([(s % n) / n for s in total])
    centre = shared(spark, (whole, left))

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - centre.value[0]) - centre.value[1]

    trace = float(_sum(table, 1, lambda x: np.array([np.square(centred(x)).sum()]))[0]) / n

    def product(block: np.ndarray) -> np.ndarray:
        sent = shared(spark, block)

        def of_batch(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ sent.value)

        return _sum(table, block.size, of_batch).reshape(block.shape) / n

    wanted = min(dim, params.components)
    values, directions, residuals = lobpcg(product, dim, wanted, params) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)), np.zeros(0))
    kept = values > 1e-12 * max(trace, 1e-300)
    directions = directions[:, kept]
    if directions.size:
        directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return Fit(n, total, directions, values[kept], trace, residuals[kept])


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """sum (n x - S)^2 of each row as exact integers; null beyond 64 bits."""
    top = max(n * int(np.abs(x).max(initial=0)), max((abs(int(s)) for s in sums), default=0)) * 2
    if top * top * x.shape[1] < 1 << 63:
        return np.square(x * n - sums.astype(np.int64)).sum(axis=1).tolist()
    if top < 1 << 62:  # n x - S fits; its square is taken in two halves
        d = np.abs(x * n - sums.astype(np.int64))
        low, high = (d & 0xFFFFFF).astype(object), (d >> 24).astype(object)
        exact = ((high * high << 48) + (2 * high * low << 24) + low * low).sum(axis=1)
    else:
        exact = np.square(x.astype(object) * n - sums).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """A row for each row whose vector is whole and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    vectors has (vec_id, embedding); other columns play no part. Rows are left out whose vector is null, holds null or
    non-finite entries, or is shorter than the longest. Components are numbered from 1 by falling eigenvalue, at most
    ``params.components`` and the dimension; those without variance (fewer distinct rows than that, or one) don't come. Signs
    make the largest entry of a component positive. Entries beyond 2**62 / 1024 count as that. Equal eigenvalues have some orthonormal basis of their space. Null and
    repeated vec_ids get their rows; an empty table gives none. deviation is exact, null if it needs more than 64 bits.

    Three things grow with the dimension and not with the rows: what a task sends to the sums, what the driver solves and
    what tasks are sent. Each round of LOBPCG is a scan of the written rows with a map-side sum.
    """
    spark = vectors.sparkSession
    rows = written(_rows(vectors), "whole-vectors")
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = rows.agg(F.max(F.size("x")).alias("d")).first()["d"]
    if not dim:
        return spark.createDataFrame([], out)
    table = rows.where(F.size("x") == dim)
    found = fit(table, dim, params)
    k = len(found.values)
    whole, left = np.array([s // found.n for s in found.sums], np.int64), np.array([(s % found.n) / found.n for s in found.sums])
    sent = shared(spark, (whole, left, found.directions / np.sqrt(found.values)))

    def whitened(x: np.ndarray) -> np.ndarray:
        whole, left, to = sent.value
        return ((x - whole) - left) @ to

    error = 0.0
    if k:
        mean = _sum(table, k, lambda x: whitened(x).sum(axis=0)) / found.n

        def second(x: np.ndarray) -> np.ndarray:
            y = whitened(x) - mean
            return y.T @ y

        error = float(np.abs(_sum(table, k * k, second).reshape(k, k) / found.n - np.eye(k)).max())
    n, sums, share = found.n, found.sums, found.values / found.trace if k else np.zeros(0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x, rows = _matrix(batch.column(1)), np.repeat(np.arange(batch.num_rows), k)
            cols = [
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(len(rows), n, np.int64)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(rows)),
                pa.array(whitened(x).ravel()),
                pa.array(np.tile(share, batch.num_rows)),
                pa.array(np.full(len(rows), error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[c.strip().split(" ")[0] for c in out.split(",")])

    return table.mapInArrow(work, out)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
