"""Cross-entropy difference of matched target and background n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe_in, written
from .tokens import mix, token_runs

_PAIR = np.uint64(0xA0761D6478BD642F)
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Params:
    add: float = 0.1  # added to each word count
    prior: float = 8.0  # pairs that a word's own share is worth beside what follows the word before
    block_bytes: int = 1 << 22  # text of one block: a task counts and scores that much at once, and a longer text alone
    owner_bytes: int = 1 << 24  # text that an owner counts keys for; owners grow with the corpus


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _zip(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that the planes that hold little take no room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unzip(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


_BLOCK = "block long, bytes long, rows binary"


def _blocks(p: Params):
    """Rows (doc_id, text, in_target, in_background) a few megabytes at a time, each lot one compressed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size = TaskContext.get().partitionId() << 32, [], 0

        def done(at: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([size]), pa.array([_packed(pa.Table.from_batches(held))], pa.binary())], names=["block", "bytes", "rows"])

        for b in batches:
            ends = np.cumsum(pa.compute.binary_length(b.column(1).cast(pa.large_binary())).to_numpy(zero_copy_only=False)) if b.num_rows else np.empty(0)
            at = 0
            while at < b.num_rows:
                start = int(ends[at - 1]) if at else 0
                stop = min(b.num_rows, max(at + 1, int(np.searchsorted(ends, start + p.block_bytes - size, "right"))))
                held.append(b.slice(at, stop - at))
                size += int(ends[stop - 1]) - start
                at = stop
                if size >= p.block_bytes or at < b.num_rows:
                    yield done(base)
                    base, held, size = base + 1, [], 0
        if held:
            yield done(base)

    return run


class _Keys:
    """The words and pairs of a block as sorted distinct keys, even for words and odd for pairs, and where each occurs."""

    def __init__(self, data: bytes) -> None:
        self.rows = _unpacked(data)
        words, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for first, w, r in token_runs(self.rows["text"]):
            words.append(w)
            rows.append(r + first)
        words, self.row = np.concatenate(words), np.concatenate(rows)
        self.after = np.flatnonzero(self.row[1:] == self.row[:-1]) + 1  # words that follow one in their text
        n = len(words)
        keys = np.concatenate([words & ~_ONE, mix(words[self.after - 1] * _PAIR + words[self.after]) | _ONE])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.word, self.pair = at[:n], at[n:]
        self.flags = {name: self.rows[name].to_numpy() for name in ("in_target", "in_background")}

    def counts(self, name: str) -> np.ndarray:
        on = self.flags[name][self.row]
        out = np.bincount(self.word[on], minlength=len(self.keys))
        return out + np.bincount(self.pair[on[self.after]], minlength=len(self.keys))

    def own(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the text of each occurrence has its key."""
        _, where, n = np.unique(row * np.int64(len(self.keys)) + at, return_inverse=True, return_counts=True)
        return n[where]


def _cuts(keys: np.ndarray, owners: int) -> np.ndarray:
    lows = np.array([-(-(o << 64) // owners) for o in range(owners)], np.uint64)
    return np.append(np.searchsorted(keys, lows, "left"), len(keys))


_SENT = "owner int, block long, keys binary, target binary, background binary"


def _send(owners: int):
    """Each block sends the owners of key ranges its sorted keys and their counts, key by key the gap to the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                k = _Keys(data.as_py())
                target, background, cuts = k.counts("in_target"), k.counts("in_background"), _cuts(k.keys, owners)
                out = [
                    (o, block, _zip(np.diff(k.keys[lo:hi], prepend=np.uint64(0))), _zip(target[lo:hi]), _zip(background[lo:hi]))
                    for o, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                    if lo < hi
                ]
                if out:
                    yield _columns(_SENT, out)

    return run


_ANSWER = "block long, owner int, target binary, background binary, words long, target_words long, background_words long"


def _answer(t: pa.Table) -> pa.Table:
    """An owner adds up its keys and tells each block the sums of the keys it sent. One answer also has the owner's totals."""
    lists = [np.cumsum(_unzip(x.as_py()), dtype=np.uint64) for x in t["keys"]]
    keys, at = np.unique(np.concatenate(lists), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([_unzip(x.as_py()) for x in t[name]]).astype(np.float64), len(keys)).astype(np.int64) for name in ("target", "background")]
    word = keys & _ONE == 0
    totals = [int((word & ((sums[0] > 0) | (sums[1] > 0))).sum()), int(sums[0][word].sum()), int(sums[1][word].sum())]
    out, start = [], 0
    for owner, block, k in zip(t["owner"].to_pylist(), t["block"].to_pylist(), lists, strict=True):
        mine = at[start : start + len(k)]
        out.append((block, owner, _zip(sums[0][mine]), _zip(sums[1][mine]), *(totals if start == 0 else (0, 0, 0))))
        start += len(k)
    return pa.Table.from_batches([_columns(_ANSWER, out)])


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _columns(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


OUT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _losses(k: _Keys, counts: np.ndarray, flags: np.ndarray, vocabulary: int, total: int, p: Params, own: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Minus the log of each word's probability after the one before it, or alone at the start of a text.

    ``own``: how often its text has each word and pair. Texts the model has counted are scored without their own counts.
    """
    on = flags[k.row]
    word, pair, totals = counts[k.word].astype(np.float64), counts[k.pair].astype(np.float64), np.full(len(k.row), float(total))
    if own is not None:
        word -= own[0] * on
        pair -= own[1] * on[k.after]
        totals -= np.bincount(k.row, minlength=len(flags))[k.row] * on
    alone = (word + p.add) / (totals + p.add * (vocabulary + 1))
    before = word[k.after - 1]  # the words before, of which those that end a text go on to nothing
    out = alone.copy()
    out[k.after] = (pair + p.prior * alone[k.after]) / (before + p.prior)
    return -np.log(out)


def _scores(vocabulary: int, totals: tuple[int, int], p: Params, leave_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, answers in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                k = _Keys(data.as_py())
                answers = sorted(answers or [], key=lambda a: a["owner"])
                own = (k.own(k.word, k.row), k.own(k.pair, k.row[k.after])) if leave_out else None
                m = k.rows.num_rows
                n = np.bincount(k.row, minlength=m)
                some, means = np.maximum(n, 1), []
                for name, total in zip(("target", "background"), totals, strict=True):
                    counts = np.concatenate([np.empty(0, np.uint64), *(_unzip(a[name]) for a in answers)])
                    means.append(np.bincount(k.row, _losses(k, counts, k.flags[f"in_{name}"], vocabulary, total, p, own), minlength=m) / some)
                yield pa.RecordBatch.from_arrays([k.rows["doc_id"].combine_chunks() if isinstance(k.rows["doc_id"], pa.ChunkedArray) else k.rows["doc_id"], pa.array(n), *map(pa.array, means), pa.array(means[1] - means[0])], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def score(docs: DataFrame, in_target: Column, in_background: Column | None = None, leave_out: bool = True, p: Params = Params()) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score): the mean over words of background loss less target loss.

    Both models are pair models over one vocabulary, the words of the target and background rows, with the same smoothing.
    Words are runs of letters and digits, A-Z as a-z. Every distinct word and pair has its own counts (by 64-bit hash), so
    what is gathered grows with the corpus: blocks of texts send sorted compressed keys and counts to the owners of key
    ranges, whose number grows with the input, and get back the sums of the keys they sent. A hot word or pair is one entry
    per block. With ``leave_out`` a text is scored by models without its own counts. Higher scores are likelier of the target.

    Null and empty texts have no words and score 0; an empty target or background leaves a uniform model. Null flags are
    false. Repeated rows and null doc_ids are rows like others, and each gets its score.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), flag(in_target).alias("in_target"), flag(F.lit(True) if in_background is None else in_background).alias("in_background"))
    blocks = written(rows.mapInArrow(_blocks(p), _BLOCK), "lm-blocks")
    owners = max(1, -(-(blocks.agg(F.sum("bytes")).first()[0] or 0) // p.owner_bytes))
    answers = written(blocks.select("block", "rows").mapInArrow(_send(owners), _SENT).groupBy("owner").applyInArrow(_answer, _ANSWER), "lm-counts")
    totals = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "target_words", "background_words")]).first()
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "target", "background")).alias("answers"))
    joined = blocks.select("block", "rows").join(by_block, "block", "left").select("rows", "answers")
    return joined.mapInArrow(_scores(totals[0], (totals[1], totals[2]), p, leave_out), OUT)


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("good")).distinct()
    marked = maybe_in(docs, F.xxhash64("doc_id"), bitmap(good, F.xxhash64("good")))
    near = marked.where("__ls_hit").join(good, F.col("doc_id") == F.col("good"), "left")
    flagged = near.select("doc_id", "text", F.col("good").isNotNull().alias("target")).unionByName(marked.where("not __ls_hit").select("doc_id", "text", F.lit(False).alias("target")))
    return score(flagged, F.col("target"))
