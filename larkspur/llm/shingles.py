"""Near-dedup by shingle similarity: prefix filtering by two orders, then whole shingle sets of what may be similar."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, bitmap_array, has_bit, maybe_in, shared, written
from .components import components
from .tokens import NO_SPACE, mix, token_runs

WIDTH, SIMILARITY = 5, 0.8
EVERY, COMMON = 8, 2  # one row in EVERY is looked at for shingles that more than COMMON of them have, which come last
MANY = 1000  # rows of a shingle from which on it counts as equally common
BLOCK = 1 << 20  # shingles of rows that are compared with each other at once

_PREFIX = "key long, row long, spare int, length int"


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles. A shorter text is one shingle; texts without words share one of their own."""
    out = [np.zeros(1, np.uint64)] * len(texts)
    factors = [np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % (1 << 64)) for k in range(width)]
    for first, words, rows in token_runs(texts, NO_SPACE):
        n = len(words) - width + 1
        h, of = np.empty(0, np.uint64), np.empty(0, np.int64)
        if n > 0:
            ok = rows[:n] == rows[width - 1 :]
            h = sum(words[k : k + n] * factors[k] for k in range(width))[ok]
            of = rows[:n][ok]
        if not len(words):
            continue
        found, starts, counts = np.unique(rows, return_index=True, return_counts=True)
        short = counts < width
        if short.any():
            one = [sum((words[s + k : s + k + 1] * factors[k] for k in range(c)), np.full(1, c, np.uint64))[0] for s, c in zip(starts[short].tolist(), counts[short].tolist(), strict=True)]
            h, of = np.append(h, np.array(one, np.uint64)), np.append(of, found[short])
        h = mix(h)
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
        for r, part in zip(found.tolist(), np.split(h, np.searchsorted(of, found[1:], "left")), strict=True):
            out[first + r] = part
    return out


def _least_shared(n: int, similarity: float) -> int:
    """Shingles that a set of n shares at least with one as similar."""
    return math.ceil(similarity * n - 1e-9)


def _spare(n: int, similarity: float) -> int:
    """How many more shingles a prefix has than it needs. It grows no faster than _least_shared; see similar_links."""
    return _least_shared(n, similarity) // 8


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                sets = shingle_sets(b.column(0).slice(at, 1000), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["key"])

    return run


def _hot(table: DataFrame, width: int) -> np.ndarray:
    """A bitmap of shingles that many rows have. It only sets the order: any order gives the same links."""
    some = table.where(F.pmod(F.xxhash64("__ls_row"), F.lit(EVERY)) == 0).select(F.coalesce("text", F.lit("")))
    common = some.mapInArrow(_sampled(width), "key long").groupBy("key").count().where(F.col("count") > COMMON)
    return bitmap_array(bitmap(common, F.col("key")))


def _prefixes(hot, width: int, similarity: float):
    """Each row under the first shingles of its set, common ones last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = shingle_sets(part.column(1), width)
                spare = [_spare(len(s), similarity) for s in sets]
                keys = [s[np.argsort(has_bit(hot.value, s), kind="stable")[: len(s) - _least_shared(len(s), similarity) + 1 + x]] for s, x in zip(sets, spare, strict=True)]
                n = np.array([len(k) for k in keys])
                rows = np.repeat(part.column(0).to_numpy(), n)
                columns = np.concatenate(keys).view(np.int64), rows, np.repeat(np.array(spare, np.int32), n), np.repeat(n.astype(np.int32), n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "row", "spare", "length"])

    return run


_SHARED = "key long, row long, spare int, length int, common int"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: those of keys that several rows have, with their number, or MANY. Holds MANY rows of a key at most."""
    held: list[np.ndarray] | None = None
    over = None  # the key that has had MANY rows already
    for b in batches:
        new = [c.to_numpy() for c in b.columns]
        t = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        starts = np.flatnonzero(np.append(True, t[0][1:] != t[0][:-1]))
        last = int(starts[-1])
        n = np.diff(np.append(starts, len(t[0])))
        n[0] = MANY if over is not None and t[0][0] == over else n[0]
        count = np.repeat(np.minimum(n, MANY), np.diff(np.append(starts, len(t[0]))))
        if count[-1] < MANY:
            held, over = [x[last:] for x in t], None
            t, count = [x[:last] for x in t], count[:last]
        else:
            held, over = None, t[0][-1]
        yield _several(t, count)
    if held is not None:
        yield _several(held, np.full(len(held[0]), len(held[0])))


def _several(t: list[np.ndarray], count: np.ndarray) -> pa.RecordBatch:
    ok = count > 1
    return pa.RecordBatch.from_arrays([*(pa.array(x[ok]) for x in t), pa.array(count[ok].astype(np.int32))], names=["key", "row", "spare", "length", "common"])


def _attended(buckets: DataFrame) -> DataFrame:
    """(key, row): the shingles a row has to meet others in. As many as it has spare, the most common ones, it may leave out;
    those that no other row has count first."""
    by_row = Window.partitionBy("row")
    ranked = buckets.withColumn("rank", F.row_number().over(by_row.orderBy("common", "key"))).withColumn("n", F.count(F.lit(1)).over(by_row))
    return ranked.where(F.col("rank") + F.col("length") - F.col("n") <= F.col("length") - F.col("spare")).select("key", "row")


def _near_in(similarity: float, width: int):
    """(a, b) that connect all rows of a block whose sets are similar: each found row is compared with those not yet found."""

    def run(t: pa.Table) -> pa.Table:
        rows = t["row"].to_numpy()
        sets = shingle_sets(t["t"], width)
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        keys, ids = np.unique(flat, return_inverse=True)
        of = np.repeat(np.arange(len(sets)), sizes)
        by_key = np.argsort(ids, kind="stable")
        holders, cuts = of[by_key], np.append(0, np.cumsum(np.bincount(ids, minlength=len(keys))))
        ends = np.append(0, np.cumsum(sizes))
        left, right, rest = [], [], np.ones(len(sets), bool)
        for first in range(len(sets)):
            if not rest[first]:
                continue
            rest[first], queue = False, [first]
            while queue:
                x = queue.pop()
                mine = ids[ends[x] : ends[x + 1]]
                lo, n = cuts[mine], cuts[mine + 1] - cuts[mine]
                at = np.repeat(lo - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))
                both = np.bincount(holders[at], minlength=len(sets))
                near = np.flatnonzero(rest & (both >= similarity * (sizes + sizes[x] - both) - 1e-9))
                rest[near] = False
                left += [x] * len(near)
                right += near.tolist()
                queue += near.tolist()
        return pa.table({"a": rows[np.array(left, int)], "b": rows[np.array(right, int)]})

    return run


def _similar(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = zip(shingle_sets(part.column(2), width), shingle_sets(part.column(3), width), strict=True)
                for i, (x, y) in enumerate(sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[at + i] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


def verified(pairs: DataFrame, table: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose whole sets are similar. Texts of no other rows are shuffled."""
    pairs = written(pairs.distinct(), "pairs")
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), table)
    one, two = texts.select(F.col("row").alias("a"), F.col("t").alias("ta")), texts.select(F.col("row").alias("b"), F.col("t").alias("tb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return written(joined.mapInArrow(_similar(width, similarity), "a long, b long"), "similar")


def _texts_of(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(row, t) of rows(row) and a few more, which a bitmap can't tell from them."""
    found = maybe_in(table.select("__ls_row", F.coalesce("text", F.lit("")).alias("t")), F.xxhash64("__ls_row"), bitmap(rows, F.xxhash64("row")))
    return found.where("__ls_hit").select(F.col("__ls_row").alias("row"), "t")


def similar_links(table: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of __ls_row whose shingle sets have a Jaccard similarity of at least ``similarity``, enough of them to
    connect all that have.

    In one order of all shingles the first n - m + 1 of a set of n, which shares m at least, hold one that a similar set has among its
    first. Prefixes are longer by a spare s, so they share s + 1 (the larger set's s, for m grows with n no slower than s): each
    row can leave out the s of its prefix that most rows share, and still meets each similar row in one that is left. The
    first order puts shingles last that are common in a sample; the second counts prefixes exactly. So texts that share a
    passage, but are otherwise their own, meet nobody.

    Rows that meet, directly or through others, form a group. A group's texts come together in blocks of bounded size, each block
    with each other block, and are compared there; only links that connect are sent on. Nothing is left out.
    """
    hot = shared(table.sparkSession, _hot(table, width))
    keys = table.select(F.col("__ls_row").alias("row"), F.coalesce("text", F.lit("")).alias("t")).mapInArrow(_prefixes(hot, width, similarity), _PREFIX)
    buckets = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_counted, _SHARED)
    met = written(_attended(buckets), "attended")
    least = met.groupBy("key").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least")
    groups = components(met.join(least, "key").where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b")))
    texts = _texts_of(groups.select(F.col("node").alias("row")), table)
    members = texts.join(groups, F.col("row") == F.col("node")).select("row", "t", F.col("root").alias("group"))
    sizes = members.groupBy("group").agg(F.sum(F.length("t")).alias("chars"))
    blocks = sizes.select("group", F.ceil(F.col("chars") / (BLOCK * 6)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("row"), F.greatest("blocks", F.lit(1))).cast("int")
    other = F.explode(F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("own"))).otherwise(F.array(F.lit(0))))
    dealt = members.join(written(blocks, "blocks"), "group").withColumn("own", own).withColumn("other", other)
    placed = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row", "t")
    return written(placed.groupBy("group", "i", "j").applyInArrow(_near_in(similarity, width), "a long, b long"), "similar")
