"""Suffix-array dedup: bytes of 100-byte strings that also start earlier are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bitmap_array, has_bit, maybe_in, written
from .suffix import permuted_prefixes, suffix_array
from .tokens import _powers, mix

LENGTH = 100  # bytes of a string that counts as repeated
_GRAM = 40  # bytes of an anchor
_WINDOW = LENGTH - _GRAM + 1  # anchors that fit into such a string
_LEFT, _RIGHT = LENGTH - _GRAM, LENGTH  # bytes before and after an anchor's start that such strings reach
_PIECE = 1 << 20  # places looked at together
SHARD_BYTES = 1 << 20  # bytes whose suffixes are sorted together
HOT = SHARD_BYTES // (_LEFT + _RIGHT)  # contexts of one anchor that still fit into a shard; the strings of more are compared by hash
_HOT_BITS = 22
NULL_ID = -(1 << 63)

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _row_hash(g: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray) -> np.ndarray:
    out = g.view(np.uint64).copy()
    for m, x in zip(_M, (doc, tie, pos), strict=False):
        out = mix(out + m) ^ x.astype(np.int64).view(np.uint64) * _M[3]
    return mix(out)


class Piece:
    """Anchors of one text from place a on: hash, place and context of the least gram of every window of 100 bytes.

    Equal strings have the same least gram (the first of equal ones) at the same offset, so the anchors of a string and of
    its copies have equal hashes. A context is what strings around an anchor can reach.
    """

    def __init__(self, text: np.ndarray, a: int, b: int) -> None:
        """Windows that start in [a, b)."""
        self.base = max(0, a - _LEFT)
        part = text[self.base : min(len(text), b + 2 * LENGTH)]
        self.n = len(text)
        self.up, self.down = _powers(len(part) + 1)
        self.sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[:-1], out=self.sums[1:])
        grams = self.hashes(np.arange(a - self.base, b - self.base + _WINDOW - 1), _GRAM)
        low = np.uint64((1 << 21) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        k = 1
        while 2 * k <= _WINDOW:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if k < _WINDOW:
            least = np.minimum(least[: len(least) - (_WINDOW - k)], least[_WINDOW - k :])
        at = (least & low).astype(np.int64)
        at = at[np.append(True, at[1:] != at[:-1])]
        self.g, self.pos = grams[at].view(np.int64), at + a
        self.start, self.end = np.maximum(self.pos - _LEFT, 0), np.minimum(self.pos + _RIGHT, self.n)
        self.c = self._contexts()
        # Contexts that this text has had before (runs of one phrase) need no shuffle to be known as repeated.
        order = np.lexsort((self.pos, self.c, self.g))
        g, c = self.g[order], self.c[order]
        again = np.append(False, (g[1:] == g[:-1]) & (c[1:] == c[:-1]))
        self.again = np.sort(order[again])
        self.first = np.sort(order[~again])

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at])

    def _contexts(self) -> np.ndarray:
        sizes = self.end - self.start
        h = self.hashes(self.start - self.base, sizes)
        return mix(h + ((self.pos - self.start) * 256 + sizes).astype(np.uint64) * _M[1]).view(np.int64)


def _pieces(text: np.ndarray) -> Iterator[Piece]:
    windows = len(text) - LENGTH + 1
    for a in range(0, windows, _PIECE):
        yield Piece(text, a, min(windows, a + _PIECE))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for b in batches:
        texts = b.column(2).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        for i, (doc, tie) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            yield doc, tie, data[offsets[i] : offsets[i + 1]]


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


_ANCHOR = ["g", "c", "doc", "tie", "pos"]
_HELD = 1 << 19  # anchors that a task compares with each other before they are shuffled


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors, of equal contexts that a task holds together the first alone; the others are covered whatever comes."""
    held, n = [], 0
    for doc, tie, text in _texts(batches):
        for p in _pieces(text):
            m = len(p.first)
            held.append((p.g[p.first], p.c[p.first], np.full(m, doc, np.int64), np.full(m, tie, np.int32), p.pos[p.first].astype(np.int32)))
            n += m
            if n > _HELD:
                yield from _combined(held)
                held, n = [], 0
    if held:
        yield from _combined(held)


def _combined(held: list) -> Iterator[pa.RecordBatch]:
    g, c, doc, tie, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    key = mix(g.view(np.uint64) * _M[0] ^ c.view(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    some = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
    some = some[np.lexsort((pos[some], tie[some], doc[some], c[some], g[some]))]
    new = np.append(True, (g[some][1:] != g[some][:-1]) | (c[some][1:] != c[some][:-1]))[: len(some)]
    first = some[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(some) else some
    covered = np.zeros(len(g), bool)
    covered[some] = (doc[some] != doc[first]) | (tie[some] != tie[first]) | (pos[some] != pos[first])
    for at in range(0, len(g), 50_000):
        yield _batch([*_ANCHOR, "covered"], [x[at : at + 50_000] for x in (g, c, doc, tie, pos, covered)])


_MARK = ["g", "id", "doc", "tie", "pos"]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by g, c, doc, tie, pos: those covered already, all but the first of equal contexts (id null), and the first of each
    context where an anchor has several (id set). Carries one row over, however many an anchor has."""
    last = None  # the first row of the current context and the number of that context within its anchor
    for b in batches:
        covered = b.column(5).to_numpy(zero_copy_only=False)
        cols = [b.column(i).to_numpy() for i in range(5)]
        gone = [x[covered] for x in cols]
        yield _batch(_MARK, [gone[0], pa.nulls(len(gone[0]), pa.int64()), *gone[2:]])
        cols = [x[~covered] for x in cols]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.concatenate([np.array([v], c.dtype), c]) for v, c in zip(last[0], cols, strict=True)]
        g, c = cols[0], cols[1]
        new_g = np.append(True, g[1:] != g[:-1])
        new_c = new_g | np.append(True, c[1:] != c[:-1])
        i = np.arange(len(g))
        first = np.maximum.accumulate(np.where(new_c, i, 0))
        group = np.maximum.accumulate(np.where(new_g, i, 0))
        number = np.cumsum(new_c)
        number = number - number[group]
        if last is not None:
            number[group == 0] += last[1]
        later = (cols[2] != cols[2][first]) | (cols[3] != cols[3][first]) | (cols[4] != cols[4][first])
        covered = np.flatnonzero(~new_c & later)
        second = np.flatnonzero(new_c & (number == 1))  # the first context of an anchor follows once there is a second
        # If the row carried over opened its anchor, it is row 0 here, and group[second] leads to it.
        reps = np.concatenate([np.flatnonzero(new_c & (number >= 1) & (i >= (last is not None))), group[second[second > 0]]])
        ids = _row_hash(*(cols[k][reps] for k in (0, 2, 3, 4))).view(np.int64)
        rows = np.concatenate([covered, reps])
        null = pa.nulls(len(covered), pa.int64())
        yield _batch(_MARK, [cols[0][rows], pa.concat_arrays([null, pa.array(ids)]), *(cols[k][rows] for k in (2, 3, 4))])
        end = int(first[-1])
        last = [x[end] for x in cols], int(number[-1])


_CONTEXT = "g long, h long, doc long, tie int, start int, end int, bytes binary"


def _spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Sorted spans with those that touch made one."""
    if not len(starts):
        return []
    head = np.append(True, starts[1:] > np.maximum.accumulate(ends)[:-1])
    return list(zip(starts[head].tolist(), np.maximum.reduceat(ends, np.flatnonzero(head)).tolist(), strict=True))


def _contexts(wanted, hot):
    """Contexts to compare byte by byte; of hot anchors the hashes of their strings instead (bytes null); and the spans that
    a text itself has had before (g null)."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for doc, tie, text in _texts(batches):
            for p in _pieces(text):
                own = _spans_of(p.start[p.again], p.end[p.again])
                g, m = p.g[p.first], len(p.first)
                take = has_bit(wanted.value, _row_hash(g, np.full(m, doc, np.int64), np.full(m, tie, np.int32), p.pos[p.first].astype(np.int32)))
                by_hash = has_bit(hot.value, g)
                few = p.first[take & ~by_hash]
                if len(few):
                    start, sizes = p.start[few], p.end[few] - p.start[few]
                    at = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                    out.append((doc, tie, start, p.end[few], p.g[few], None, text[at]))
                many = p.first[take & by_hash]
                if len(many):
                    size = p.end[many] - p.start[many] - LENGTH + 1
                    at = np.repeat(p.start[many] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(int(size.sum()))
                    h = p.hashes(at - p.base, LENGTH)
                    _, one = np.unique(h, return_index=True)  # a string's first place, for at ascends with the anchors
                    later = np.setdiff1d(np.arange(len(at)), one)
                    later = np.unique(at[later][~np.isin(at[later], at[one])])
                    own += _spans_of(later, later + LENGTH)
                    at, h = at[one], h[one]
                    half = LENGTH // 2
                    other = mix(p.hashes(at - p.base, half) * _M[0] ^ p.hashes(at - p.base + half, LENGTH - half))
                    out.append((doc, tie, at, at + LENGTH, h.view(np.int64), other.view(np.int64), None))
                if own:
                    out.append((doc, tie, *(np.array(x) for x in zip(*own, strict=True)), None, None, None))
                n += len(few) + (len(at) if len(many) else 0) + len(own)
                if n > 20_000:
                    yield _rows(out)
                    out, n = [], 0
        if out:
            yield _rows(out)

    def _rows(parts: list[tuple]) -> pa.RecordBatch:
        doc, tie, start, end, g, h, data = zip(*parts, strict=True)
        sizes = [len(x) for x in start]
        start, end = np.concatenate(start), np.concatenate(end)
        hashes = []
        for column in (g, h):
            gone = np.repeat([x is None for x in column], sizes)
            hashes.append(pa.array(np.concatenate([np.zeros(n, np.int64) if x is None else x for x, n in zip(column, sizes, strict=True)]), mask=gone))
        none = np.repeat([x is None for x in data], sizes)
        offsets = np.append(0, np.cumsum(np.where(none, 0, end - start))).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.uint8), *[x for x in data if x is not None]])
        valid = pa.array(~none).buffers()[1]
        held = pa.Array.from_buffers(pa.binary(), len(none), [valid, pa.py_buffer(offsets), pa.py_buffer(flat)])
        ids = [pa.array(np.repeat(np.array(x, k), sizes)) for x, k in ((doc, np.int64), (tie, np.int32))]
        return _batch(names, [*hashes, *ids, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), held])

    return run


_SPAN = "doc long, tie int, start int, end int"


def _twice(start: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number, start, bytes) of the parts cut to what strings reach whose hash is there more than once; equal strings have
    equal hashes, so nothing that repeats is cut off."""
    sizes = np.array([len(x) for x in parts])
    flat = np.frombuffer(b"".join(parts), np.uint8)
    up, down = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    n = np.maximum(sizes - LENGTH + 1, 0)
    part = np.repeat(np.arange(len(parts)), n)
    place = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
    at = place + (np.cumsum(sizes) - sizes)[part]
    h = (sums[at + LENGTH] - sums[at]) * down[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    part, place = part[twice], place[twice]
    head = np.flatnonzero(np.diff(part, prepend=-1))
    tail = np.append(head[1:], len(part))[: len(head)] - 1
    which, a, z = part[head], place[head], place[tail] + LENGTH
    return which, start[which] + a, [parts[i][x:y] for i, x, y in zip(which.tolist(), a.tolist(), z.tolist(), strict=True)]


def repeated_spans(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, tie, start, end) of what strings cover that are in one of the parts at a smaller (doc, tie, place)."""
    which, start, parts = _twice(start, parts)
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    doc, tie = doc[which], tie[which]
    sizes = np.array([len(x) for x in parts])
    flat = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1)
    s = flat.astype(np.int16) + 2
    s[ends - 1] = 1
    s = np.append(s, 0)
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(len(flat)) - (ends - sizes - 1)[part]
    order = suffix_array(s)
    shared = permuted_prefixes(s, order)
    order = order[order < len(flat)]
    order = order[sizes[part[order]] - offset[order] >= LENGTH]
    if not len(order):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    # Suffixes left out here are shorter than LENGTH and part no run of equal strings from itself.
    run = np.cumsum(shared[order] < LENGTH)
    several = np.bincount(run)[run] > 1
    run, order = run[several], order[several]
    if not len(order):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    where = part[order]
    d, t, at = doc[where], tie[where], start[where] + offset[order]
    by = np.lexsort((at, t, d, run))
    run, d, t, at = run[by], d[by], t[by], at[by]
    first = np.maximum.accumulate(np.where(np.append(True, run[1:] != run[:-1]), np.arange(len(run)), 0))
    later = (d != d[first]) | (t != t[first]) | (at != at[first])
    d, t, at = d[later], t[later], at[later]
    by = np.lexsort((at, t, d))
    d, t, at = d[by], t[by], at[by]
    if not len(d):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (at[1:] > at[:-1] + LENGTH))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(d)) - 1
    return d[head], t[head], at[head], at[tail] + LENGTH


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of whole anchors' contexts, about SHARD_BYTES at a time."""

    def done(t: pa.Table) -> pa.RecordBatch:
        spans = repeated_spans(t["doc"].to_numpy(), t["tie"].to_numpy(), t["start"].to_numpy().astype(np.int64), t["bytes"].to_pylist())
        return _batch(["doc", "tie", "start", "end"], [x.astype(k) for x, k in zip(spans, (np.int64, np.int32, np.int32, np.int32), strict=True)])

    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            held.append(part := b.slice(at, 1000))
            size += part.nbytes
            if size >= SHARD_BYTES:
                t = pa.Table.from_batches(held)
                g = t["g"].to_numpy()
                whole = int(np.searchsorted(g, g[-1], "left"))
                if whole:
                    yield done(t.slice(0, whole))
                rest = t.slice(whole).combine_chunks()
                held, size = rest.to_batches(), rest.nbytes
    if held:
        yield done(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = b.column(3).to_pylist()
        out = []
        for i, (_, _, text) in enumerate(_texts(iter([b]))):
            gone = np.zeros(len(text) + 1, np.int32)
            for x in spans[i] or ():
                gone[x["start"]] += 1
                gone[min(x["end"], len(text))] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            n_spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
            out.append((len(text), int(gone.sum()), n_spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield _batch(["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())])


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, tie, start, end): byte spans of docs(doc, tie, text) that 100-byte strings cover which also start earlier.

    Suffixes of all texts can't meet in one array, so texts are cut to shards first. Every string has an anchor, the least
    40-byte gram in it, wherever it stands. Equal contexts collapse in their tasks, then anchors and hashes of their contexts (the bytes that strings around them reach)
    are shuffled and sorted: contexts after the first of equal ones are covered whole. What is left to compare are the first
    ones where an anchor has several. Their bytes are fetched by a second scan, which finds them by a bitmap of fixed size,
    and go to shards by anchor, where suffix arrays by induced sorting and permuted common prefixes give the repeated
    strings. Anchors with more contexts than a shard holds (a passage in very many
    documents) have their strings hashed and grouped, copies combined before the shuffle. What a text repeats of itself is
    found where it lies.
    """
    anchors = docs.mapInArrow(_anchors, "g long, c long, doc long, tie int, pos int, covered boolean")
    spread = F.when(F.col("covered"), F.xxhash64("doc", "tie", "pos")).otherwise(F.col("g"))  # covered ones go anywhere
    marks = written(anchors.repartition(spread).sortWithinPartitions(*_ANCHOR).mapInArrow(_marks, "g long, id long, doc long, tie int, pos int"), "anchors")
    reps = marks.where("id is not null")
    wanted = bitmap_array(bitmap(reps, F.col("id")))
    hot = bitmap_array(bitmap(reps.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), F.col("g"), _HOT_BITS), _HOT_BITS)
    sc = docs.sparkSession.sparkContext
    found = written(docs.mapInArrow(_contexts(sc.broadcast(wanted), sc.broadcast(hot)), _CONTEXT), "contexts")
    exact = found.where("bytes is not null").drop("h").repartition("g").sortWithinPartitions("g").select("g", "doc", "tie", "start", "bytes").mapInArrow(_shards, _SPAN)
    strings = found.where("bytes is null and g is not null").select("g", "h", "doc", "tie", "start")
    firsts = written(strings.groupBy("g", "h").agg(F.min(F.struct("doc", "tie", "start")).alias("first")), "hot-strings")
    hashed = strings.join(firsts, ["g", "h"]).where(F.struct("doc", "tie", "start") != F.col("first")).select("doc", "tie", "start", (F.col("start") + LENGTH).alias("end"))
    covered = marks.where("id is null").select("doc", "tie", F.greatest(F.col("pos") - _LEFT, F.lit(0)).alias("start"), (F.col("pos") + _RIGHT).alias("end"))
    own = found.where("g is null").select("doc", "tie", "start", "end")
    return covered.unionByName(own).unionByName(exact).unionByName(hashed)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty, matches never cross documents. Order is by doc_id (null first), then start; rows
    that share a doc_id but not a text stand in the order of a text hash; rows that share both are one document, and each
    of them gets its result. Texts under 100 bytes keep all. Only texts with something to remove are shuffled.
    """
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit(""))
    rows = docs.select(doc, F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tie"), text.alias("text"))
    spans = written(repeated(rows), "spans")
    key = F.xxhash64("doc", "tie")
    marked = maybe_in(rows.withColumn("key", key), F.col("key"), bitmap(spans, key))
    whole = marked.where("not __ls_hit").select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    by_doc = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = marked.where("__ls_hit").join(by_doc, ["doc", "tie"], "left").select("doc", "tie", "text", "spans").mapInArrow(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return whole.unionByName(cut).select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
