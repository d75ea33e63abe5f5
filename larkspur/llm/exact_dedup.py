"""Exact dedup by a Golomb-coded fingerprint exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import all_but_first, bitmap, maybe_in, numbered, without, written

BLOCK_ROWS = 1 << 16  # documents whose fingerprints a task sends at once
OWNER_ROWS = 1 << 21  # documents for each owner of fingerprints: owners grow with the input

_BLOCKS = "owner int, block long, n int, k int, code binary, again binary, digests binary, counts binary, ids binary"


def _range(owner: int, owners: int) -> tuple[int, int]:
    low = -(-(owner << 64) // owners)
    return low, -(-((owner + 1) << 64) // owners) - low


def _blocks(owners: int, block_rows: int):
    """Tasks send each owner a sorted compressed list of fingerprints. Copies inside a block are one entry of it."""

    def send(rows: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        h = table["h"].to_numpy().view(np.uint64)
        ids = table["doc_id"].to_numpy()
        digests = np.frombuffer(b"".join(table["digest"].to_pylist()), ">u8").reshape(-1, 4)
        order = np.lexsort((ids, *digests.T[::-1], h))
        h, ids, digests = h[order], ids[order], digests[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (digests[1:] != digests[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(h)))
        eh = h[first]
        same = eh[1:] == eh[:-1]
        again = (counts > 1) | np.append(same, False) | np.insert(same, 0, False)
        lows = np.array([_range(o, owners)[0] for o in range(owners)], np.uint64)
        cut = [*np.searchsorted(eh, lows, "left"), len(eh)]
        at = np.append(first, len(h))
        out = []
        for o in range(owners):
            a, b = int(cut[o]), int(cut[o + 1])
            if a < b:
                k, code = golomb.encode(eh[a:b], *_range(o, owners))
                out.append((o, block, b - a, k, code, np.packbits(again[a:b]).tobytes(), digests[first[a:b]].tobytes(), counts[a:b].astype("<i4").tobytes(), ids[at[a] : at[b]].astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                held.append(part := b.slice(at, block_rows))
                n += part.num_rows
                if n >= block_rows:
                    yield send(held, base + seq)
                    seq, held, n = seq + 1, [], 0
        if n:
            yield send(held, base + seq)

    return run


_ARROW = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]


def _answer(owners: int):
    """An owner merges the lists of its range and answers each with a bitmap of the fingerprints that others have too."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        low = _range(rows[0]["owner"], owners)[0]
        lists = [golomb.decode(r["code"], r["n"], r["k"], low) for r in rows]
        values, seen = np.unique(np.concatenate([np.unique(x) for x in lists]), return_counts=True)
        shared = values[seen > 1]
        marks = [np.packbits(np.isin(x, shared, assume_unique=False)).tobytes() for x in lists]
        return pa.table({"owner": t["owner"], "block": t["block"], "marks": pa.array(marks, pa.binary())})

    return run


def _entries(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = r["n"]
                h = golomb.decode(r["code"], n, r["k"], _range(r["owner"], owners)[0])
                suspect = (np.unpackbits(np.frombuffer(r["again"], np.uint8), count=n) | np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=n)).astype(bool)
                counts = np.frombuffer(r["counts"], "<i4")
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(r["digests"])]).cast(pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(r["ids"], "<i8"))), pa.array(suspect)],
                    names=["h", "digest", "ids", "suspect"],
                )

    return run


NULL_ID = -(1 << 63)  # stands for a null doc_id, below all others


def exact_duplicates(docs: DataFrame, fingerprint: Column | None = None, owners: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Tasks send sorted Golomb-coded 64-bit fingerprints to the owners of their ranges and get back bitmaps of those that
    occur again. Texts of these suspects alone are then shuffled and grouped by their bytes; the scan finds them by a
    fixed-size bitmap. Copies collapse in each block and each task before they meet, so a text that a third of all rows
    share is some rows per task. Of equal texts the row with the largest doc_id stays.

    Null text counts as empty, a null doc_id as smaller than others. Rows that repeat both doc_id and text share their
    result, so they stay or go together.
    """
    owners = owners or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    text = F.coalesce("text", F.lit(""))
    h = (F.xxhash64("t") if fingerprint is None else fingerprint).alias("h")
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")
    rows = docs.select(ids, text.alias("t"))
    narrow = rows.select("doc_id", h, F.unhex(F.sha2("t", 256)).alias("digest"))
    blocks = written(narrow.mapInArrow(_blocks(owners, block_rows), _BLOCKS), "fingerprints")
    marks = blocks.select("owner", "block", "n", "k", "code").groupBy("owner").applyInArrow(_answer(owners), "owner int, block long, marks binary")
    entries = written(blocks.join(marks, ["owner", "block"]).mapInArrow(_entries(owners), "h long, digest binary, ids array<long>, suspect boolean"), "entries")
    suspects = entries.where("suspect").select("h", "digest", "ids")
    found = maybe_in(rows.select("doc_id", "t", h), F.col("h"), bitmap(suspects, F.col("h"))).where("__ls_hit")
    groups = (
        found.groupBy("h", "t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("t", 256)).alias("digest"), "keep_id", "group_size")
    )
    shared = suspects.join(groups, ["h", "digest"]).select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "digest")
    single = entries.where("not suspect").select(F.explode("ids").alias("doc_id"), "digest").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    back = lambda c: F.nullif(F.col(c), F.lit(NULL_ID)).alias(c)
    return shared.unionByName(single).select(back("doc_id"), back("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each text: the one with the largest doc_id, a null id last, of equal rows any."""
    table = numbered(docs)
    copied = written(exact_duplicates(table).where("group_size > 1").select(F.col("text_sha256").alias("group")).distinct(), "copied")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = maybe_in(table.select(F.col("__ls_row").alias("row"), "doc_id", digest.alias("group")), F.xxhash64("group"), bitmap(copied, F.xxhash64("group"))).where("__ls_hit")
    at = F.struct(F.col("doc_id").isNull().alias("null"), (-F.col("doc_id").cast("decimal(20)")).alias("id"), F.col("row")).alias("at")
    # A row that the bitmap takes for a copy and isn't one is alone in its group and stays.
    return without(table, all_but_first(written(found.select("row", "group", at), "members")))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
