"""Toxicity by subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import shared, written

_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 18  # rows of the embedding table: words and their character n-grams hash to them
    dim: int = 4
    n_grams: tuple[int, ...] = (3, 4, 5, 6)
    least: int = 10  # training documents that a bucket needs to have a vector
    rows: int = 2000  # labelled documents of each class that training reads at most
    longest: int = 50_000  # characters of a text that training reads; longer labelled texts are not in the sample, scoring reads all
    epochs: int = 10
    rate: float = 40.0  # falls to nothing; a bucket's step is its share of the document times this
    seed: int = 7
    cache: int = 100_000  # words whose sums a task remembers


def features(word: str, p: Params) -> list[int]:
    """The buckets of a word: itself, then the n-grams of it between angle brackets."""
    b = f"<{word}>"
    out = [zlib.crc32(b.encode()) % p.buckets]
    for n in p.n_grams:
        out += [zlib.crc32(b[i : i + n].encode()) % p.buckets for i in range(len(b) - n + 1) if n < len(b)]
    return out


_CRC = np.arange(256, dtype=np.uint32)  # what a byte does to the register of zlib's checksum
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def word_sums(words: list[str], logits: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(sum of logits over ``features``, how many they are) of each word; the checksums of all n-grams grow by a character at once."""
    of = np.array([zlib.crc32(f"<{w}>".encode()) % p.buckets for w in words], np.int64)
    sums, counts = logits[of], np.ones(len(words), np.int64)
    data = np.frombuffer("".join(f"<{w}>" for w in words).encode(), np.uint8)
    starts = np.flatnonzero(data & 0xC0 != 0x80)  # characters
    size = np.diff(np.append(starts, len(data)))
    long = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), long)
    left = np.repeat(np.cumsum(long), long) - np.arange(len(word))  # characters from here to the word's end
    at, crc = np.arange(len(word)), np.full(len(word), 0xFFFFFFFF, np.uint32)
    for n in range(1, max(p.n_grams, default=0) + 1):
        here = left[at] >= n
        at, crc = at[here], crc[here]
        for j in range(4):
            some = np.flatnonzero(size[at + n - 1] > j) if j else slice(None)
            c = crc[some]
            crc[some] = _CRC[(c ^ data[starts[at[some] + n - 1] + j]) & 0xFF] ^ (c >> np.uint32(8))
        if n in p.n_grams:
            inner = long[word[at]] > n
            w = word[at[inner]]
            sums = sums + np.bincount(w, weights=logits[(~crc[inner]).astype(np.int64) % p.buckets], minlength=len(words))
            counts = counts + np.bincount(w, minlength=len(words))
    return sums, counts


def bag(text: str, p: Params) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(_WORDS.findall(text.lower())).items():
        for f in features(word, p):
            out[f] += n
    return out


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Embeddings and softmax weights, learnt together by gradient steps over the documents' mean vectors.

    Returns what a score needs of them: for each bucket the difference of its two logits, and that of the biases.
    """
    rng = np.random.default_rng(p.seed)
    known = np.zeros(p.buckets, bool)
    for ids, _ in bags:
        known[ids] = True
    every = np.where(known[:, None], rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)), 0).astype(np.float32)
    table, dense = every[known], (np.cumsum(known) - 1).astype(np.int32)  # the rows in use, close together
    weights, bias = rng.uniform(-0.5, 0.5, (p.dim, 2)).astype(np.float32), np.zeros(2)
    for epoch in range(p.epochs):
        rate = np.float32(p.rate * (1 - epoch / p.epochs))
        for i in rng.permutation(len(bags)).tolist():
            ids, share = dense[bags[i][0]], bags[i][1]
            rows = table[ids]
            mean = share @ rows
            z = mean @ weights + bias
            z = np.exp(z - z.max())
            grad = z / z.sum()
            grad[labels[i]] -= 1
            back = (weights @ grad).astype(np.float32)
            table[ids] = rows - rate * share[:, None] * back
            weights -= rate * np.float32(0.1) * np.outer(mean, grad).astype(np.float32)
            bias -= 0.01 * rate * grad
    every[known] = table
    return (every @ (weights[:, 1] - weights[:, 0])).astype(np.float64), float(bias[1] - bias[0])


_BAGS = "doc_id long, toxic int, ids array<int>, counts array<int>"
_PACKED = "doc_id long, toxic int, ids binary, share binary"


def _bags(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                bags = [bag(t, p) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([list(x) for x in bags], pa.list_(pa.int32())), pa.array([list(x.values()) for x in bags], pa.list_(pa.int32()))],
                    names=["doc_id", "toxic", "ids", "counts"],
                )

    return run


def _packed(known):
    """Bags with the buckets that training keeps, as bytes: int32 ids and float32 shares of the whole bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, share = [], []
            for i, n in zip(b.column(2), b.column(3), strict=True):
                i, n = i.values.to_numpy(), n.values.to_numpy()
                keep = known.value[i]
                ids.append(i[keep].astype("<i4").tobytes())
                share.append((n[keep] / max(1, n.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(share, pa.binary())], names=["doc_id", "toxic", "ids", "share"])

    return run


HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, false)"


def fit(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[np.ndarray, float]:
    """Learns from at most ``p.rows`` rows of each class, those first by a hash of doc_id, and never from held-out ones.

    The sample is bounded by ``p.rows`` and ``p.longest``: of a doc_id that several rows of docs share, the least text
    counts; labelled texts over ``p.longest`` characters are left out. Null doc_ids and labels teach nothing, a doc_id with both labels
    teaches both. Bags are made in tasks and written; one task trains on what it keeps of them, packed: buckets
    that ``p.least`` texts of the sample have (a fiftieth of a small sample).
    """
    usable = labels.where(f"toxic in (0, 1) and doc_id is not null and not {HELD_OUT}").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    one = lambda k: usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.rows)
    chosen = written(one(1).unionByName(one(0)), "toxic-rows")  # 2 * p.rows pairs at most, hence the broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= p.longest)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    bags = written(found.mapInArrow(_bags(p), _BAGS), "toxic-bags")
    texts_of = bags.select(F.explode("ids").alias("id")).groupBy("id").count()
    known = np.zeros(p.buckets, bool)
    for row in texts_of.where(F.col("count") >= min(p.least, max(1, bags.count() // 50))).select("id").toLocalIterator():
        known[row["id"]] = True
    packed = bags.mapInArrow(_packed(shared(docs.sparkSession, known)), _PACKED).where(F.length("ids") > 0)
    model = packed.repartition(1).mapInArrow(_trained(p), "logits binary, bias double").first()
    if model is None:  # nothing to learn from
        return train([], np.empty(0, int), p)
    return np.frombuffer(model["logits"], "<f8"), model["bias"]


def _trained(p: Params):
    """The bounded sample in one task, which learns and gives the model alone: a lost executor costs a retry, and the driver holds no bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = lambda v, kind: np.frombuffer(v.as_buffer(), kind)
        rows = [(d.as_py(), k.as_py(), view(i, "<i4"), view(w, "<f4")) for b in batches for d, k, i, w in zip(*b.columns, strict=True)]
        rows.sort(key=lambda r: r[:2])
        logits, bias = train([r[2:] for r in rows], np.array([r[1] for r in rows], int), p)
        yield pa.RecordBatch.from_arrays([pa.array([logits.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], names=["logits", "bias"])

    return run


_TOGETHER = 10_000  # words whose sums are worked out together


def _scorer(table, bias: float, p: Params, text: int):
    """Adds score to each row: a word's sum over its buckets is worked out once, a document's mean is of such sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, known = np.asarray(table.value), {}

        def done(held: list[Counter]) -> list[float]:
            words = set().union(*held)
            new = [w for w in words if w not in known]
            if len(known) + len(new) > p.cache:
                known.clear()
                new = list(words)
            if new:
                known.update(zip(new, zip(*(x.tolist() for x in word_sums(new, logits, p)), strict=True), strict=True))
            out = []
            for text in held:
                total, n = 0.0, 0
                for word, times in text.items():
                    got = known[word]
                    total += got[0] * times
                    n += got[1] * times
                out.append(bias + (total / n if n else 0.0))
            return out

        for b in batches:
            scores, held, size = [], [], 0
            for t in (t for at in range(0, b.num_rows, 256) for t in b.column(text).slice(at, 256).to_pylist()):
                held.append(Counter(_WORDS.findall(t.lower())) if t else Counter())
                size += len(held[-1]) + 1
                if size >= _TOGETHER:
                    scores += done(held)
                    held, size = [], 0
            scores += done(held)
            z = np.clip(np.array(scores, float), -500, 500)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*b.schema.names, "__ls_score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """docs, all columns, and ``__ls_score`` in [0, 1]: higher, likelier toxic.

    The model is learnt on a bounded sample (see ``fit``) of train_on (docs unless given) and sees texts alone. Whole texts
    are scored in place, nothing is shuffled. Null and empty texts, and all texts where no label is usable, score by the
    bias alone. Labels that are null or repeat with both values count as they stand.
    """
    table, bias = fit(docs if train_on is None else train_on, labels, p)
    schema = StructType([*docs.schema.fields, StructField("__ls_score", DoubleType())])
    return docs.mapInArrow(_scorer(shared(docs.sparkSession, table), bias, p, docs.columns.index("text")), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, threshold: float = 0.5, p: Params = Params()) -> DataFrame:
    """docs, all columns, without the rows that score the threshold or more. Each row is judged by its text alone, so null
    and repeated doc_ids change nothing; null texts are scored like empty ones."""
    return scored(docs, labels, train_on, p).where(F.col("__ls_score") < threshold).select(docs.columns)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), F.col("__ls_score").alias("score"), (F.col("__ls_score") >= 0.5).cast("int").alias("predicted"))
