"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import all_but_first, bitmap, maybe_in, numbered, without, written
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
PIECE = 1 << 16  # shingles whose bits are counted at once
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CUT = bytes(0x20 if b in _SPACE else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the XXH64 values of the shingles, repeats included."""
    words = [w for w in text.translate(_CUT).split(b" ") if w]
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    stops = ends[len(words) - n :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PIECE].tolist(), stops[at : at + PIECE].tolist(), strict=True)), np.uint64, min(PIECE, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """rows(doc_id, text) -> (doc_id, fp), written."""
    return written(rows.mapInArrow(_fingerprints(width), "doc_id long, fp long"), "simhash")


#: The bits of a fingerprint in three blocks. See links().
BLOCKS = ((0, 21), (21, 42), (42, 64))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every variant within distance one of a fingerprint, once with each block left out."""
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            fp = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            for j, (lo, hi) in enumerate(BLOCKS):
                kept = [i for i in range(64) if not lo <= i < hi]
                flips = np.array([0, *(1 << i for i in kept)], np.uint64)
                mask = np.uint64(sum(1 << i for i in kept))
                # The block left out holds its number, so variants of different blocks never meet.
                keys = ((fp & mask)[:, None] ^ flips[None, :]) | np.uint64(j + 1 << lo)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], names=["key", "fp"])


def _bucket_links(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is within the radius in one large bucket: each found member is compared with those not yet found."""
    rest, left, right = np.unique(fp), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue[-1]) <= RADIUS
            at = queue.pop()
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
    return left, right


def _verify(batches: Iterator[pa.RecordBatch], small: int = 16) -> Iterator[pa.RecordBatch]:
    """From (key, fp) sorted by key: the pairs within the radius of small buckets, links that connect the same of larger ones."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def done(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        large = np.repeat(sizes > small, sizes)
        for gap in range(1, min(small, int(sizes.max(initial=1)))):
            a, b = fp[:-gap], fp[gap:]
            ok = (key[:-gap] == key[gap:]) & ~large[gap:]
            ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= RADIUS
            left.append(a[ok])
            right.append(b[ok])
        for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            more = _bucket_links(fp[s : s + n])
            left += more[0]
            right += more[1]
        a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if len(key) and key[-1] != key[0]:
            whole = int(np.searchsorted(key, key[-1], "left"))
            yield done(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
    if len(key):
        yield done(key, fp)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs within distance 3 among distinct fingerprints (fp), enough of them to connect all that are.

    Half the radius is one and a half, and the ball of radius two that one side would need has 2,081 variants. Instead the
    64 bits are three blocks: a pair that differs in one to three bits differs in some block, so with that block left out
    it is at distance two at most, and both emit all variants within one, which meet. That is 131 variants each, and
    what meets is verified on all 64 bits. Buckets stream through their tasks sorted by key; no pairs of large buckets are listed.
    """
    variants = fps.mapInArrow(_variants, "key long, fp long")
    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long").distinct()


NULL_ID = -(1 << 63)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex), component_id (smallest doc_id reachable by links).

    Documents with equal fingerprints are one node. Null and empty texts and texts without words have fingerprint zero,
    which links like any other. Null doc_ids get a row and, being smaller than others, are never a component_id unless all
    of a component are null. Repeated rows each get their row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = fingerprints(rows, SHINGLE)
    classes = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp")))
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "rooted")
    least = written(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    owners = written(joined.join(least, "root").select("fp", "component_id"), "owners")
    return table.join(owners, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_links(table: DataFrame, width: int = shingles.WIDTH, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """(a, b): pairs of __ls_row of table(__ls_row, text) whose sets of ``width``-word shingles have a Jaccard similarity of at
    least ``similarity``, enough of them to connect all rows that have such a pair.

    Rows of equal fingerprints meet the least of them, and those of fingerprints within the radius meet by ball hashing; the
    whole shingle sets of what meets are compared. At a similarity of 0.8 fingerprints differ in about ten bits, more than
    any ball can span, so prefix filtering finds the rest.
    """
    rows = fingerprints(table.select(F.col("__ls_row").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), width)
    least = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    copies = rows.join(least, "fp").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    one, two = (least.select(F.col("fp").alias(x), F.col("least").alias(f"row_{x}")) for x in ("a", "b"))
    near = links(least.select("fp")).join(one, "a").join(two, "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    known = shingles.verified(copies.unionByName(near), table, width, similarity)
    return known.unionByName(shingles.similar_links(table, width, similarity))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each component of near_duplicates: the one with the smallest doc_id, null last."""
    table = numbered(docs)
    found = near_duplicates(table.select(F.col("__ls_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    at = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("row").alias("row")).alias("at")
    members = found.join(table.select("__ls_row", "doc_id"), F.col("row") == F.col("__ls_row")).select("row", "group", at)
    return without(table, all_but_first(written(members, "members")))


def drop_similar(docs: DataFrame, width: int = shingles.WIDTH, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """docs, all columns, with one row of each component of near_links: the one with the smallest doc_id, null last.

    Rows are told apart by a row number, so null and repeated ids are rows like others, and of rows that are alike one stays.
    Null and empty texts and texts without words are alike; a text of fewer words than a shingle is one shingle.
    """
    table = numbered(docs)
    nodes = components(near_links(table, width, similarity))
    ids = maybe_in(table.select("__ls_row", "doc_id"), F.xxhash64("__ls_row"), bitmap(nodes, F.xxhash64("node"))).where("__ls_hit")
    at = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("node").alias("row")).alias("at")
    members = nodes.join(ids, nodes["node"] == ids["__ls_row"]).select(F.col("node").alias("row"), F.col("root").alias("group"), at)
    return without(table, all_but_first(written(members, "members")))


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
