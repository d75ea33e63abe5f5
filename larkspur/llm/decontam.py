"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared
from .tokens import mix, token_runs

#: The masks. A 1 is a word that must agree, a 0 a word that may differ. Chosen by enumeration: wherever the
#: words that differ stand in an overlap of 13 to 25 words, one mask fits between them. A longer overlap can be cut into
#: pieces of such lengths, and one of these agrees as well as the whole.
MASKS = ("1101100111", "1100111011", "10111000111", "1100000010111", "1111101")
MIN_OVERLAP = 13  # words that an overlap spans at least, or all words of a shorter item
SIMILARITY = 0.8  # of them agree at least
BLOCK_TOKENS = 1 << 20  # words of benchmark items looked for in one pass over the documents
HITS = 1 << 20  # hits looked at together
_PROBE_BITS = 24

OUT = "doc_id long, item_id long, doc_start long, item_start long, overlap long, mismatches long"
_FIELDS = [x.split()[0] for x in OUT.split(", ")]


def short_masks(n: int) -> list[list[int]]:
    """Masks for items of n words, fewer than MIN_OVERLAP: one fits wherever the words inside that may differ stand."""
    wrong = int(n * (1 - SIMILARITY) + 1e-9)
    parts = [x.tolist() for x in np.array_split(np.arange(1, n - 1), wrong + 2) if len(x)] if wrong else []
    return [sorted(set(range(n)).difference(*out)) for out in combinations(parts, wrong)]


class Items:
    """The words of a block of benchmark items and its seeds, sorted by hash."""

    def __init__(self, ids: list, words: list[np.ndarray]) -> None:
        self.ids, self.words = ids, words
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(words)), [len(w) for w in words])
        first = np.repeat(np.cumsum([0, *map(len, words)])[:-1], [len(w) for w in words])
        short = [(n, m) for n in sorted({len(w) for w in words if 0 < len(w) < MIN_OVERLAP}) for m in short_masks(n)]
        self.masks = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS] + [m for _, m in short]
        self.only = [0] * len(MASKS) + [n for n, _ in short]  # the masks of short items are theirs alone
        h, at, m = [], [], []
        lengths = np.array([len(w) for w in words])
        for j in range(len(self.masks)):
            seeds, where = self.seeds(j, flat, item)
            if self.only[j]:
                keep = lengths[item[where]] == self.only[j]
                seeds, where = seeds[keep], where[keep]
            h.append(seeds)
            at.append(where)
            m.append(np.full(len(where), j))
        h, at = np.concatenate(h), np.concatenate(at)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.pos = h[order], item[at][order], (at - first[at])[order]
        self.probe = np.zeros(1 << _PROBE_BITS, bool)
        self.probe[(self.h >> np.uint64(64 - _PROBE_BITS)).astype(np.int64)] = True

    def seeds(self, j: int, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes under mask j at every word where it ends in the same text, and these words' places."""
        mask = self.masks[j]
        n = len(words) - mask[-1]
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.full(n, j + 1, np.uint64)
        for k, o in enumerate(mask):
            h += words[o : o + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % (1 << 64))
        where = np.flatnonzero(rows[:n] == rows[mask[-1] :])
        return mix(h[where]), where

    def overlaps(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, start in its text, start in item, words, mismatches): the best overlap of each text and item."""
        first = np.searchsorted(rows, np.arange(int(rows[-1]) + 2 if len(rows) else 1), "left")
        diagonals = np.empty(0, np.int64)
        span = 2 * max(len(words), *map(len, self.words)) + 1
        for j in range(len(self.masks)):
            h, where = self.seeds(j, words, rows)
            near = self.probe[(h >> np.uint64(64 - _PROBE_BITS)).astype(np.int64)]
            h, where = h[near], where[near]
            lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
            n = hi - lo
            done = np.append(0, np.cumsum(n))
            # A phrase that text and item repeat gives many hits on few diagonals: some hits at a time, diagonals once.
            cuts = [*np.searchsorted(done, np.arange(0, int(done[-1]), HITS), "left").tolist(), len(n)]
            for a, b in pairwise(cuts):
                hit = np.repeat(lo[a:b] - done[a:b] + done[a], n[a:b]) + np.arange(int(done[b] - done[a]))
                at = np.repeat(where[a:b], n[a:b])
                shift = at - first[rows[at]] - self.pos[hit] + span // 2
                diagonals = np.union1d(diagonals, (rows[at] * len(self.words) + self.item[hit]) * span + shift)
        best: dict[tuple[int, int], tuple] = {}
        for d in diagonals.tolist():
            d, shift = divmod(d, span)
            (row, item), shift = divmod(d, len(self.words)), shift - span // 2
            text, own = words[first[row] : first[row + 1]], self.words[item]
            if best.get((row, item), (0,))[0] == len(own):
                continue
            a, b = max(0, -shift), min(len(own), len(text) - shift)
            same = own[a:b] == text[a + shift : b + shift]
            start, size = _segment(same)
            if size >= min(MIN_OVERLAP, len(own)):
                wrong = size - int(same[start : start + size].sum())
                found = (size - wrong, a + start + shift, a + start, size, wrong)
                if found[0] > best.get((row, item), (0,))[0]:
                    best[row, item] = found
        for (row, item), (_, at, own_at, size, wrong) in best.items():
            yield row, item, at, own_at, size, wrong


def _segment(same: np.ndarray) -> tuple[int, int]:
    """Start and length of the longest stretch of which SIMILARITY agrees, and whose ends do."""
    n = len(same)
    total = np.append(0.0, np.cumsum(same - SIMILARITY)) + 1e-9 * np.arange(n + 1)
    low = np.minimum.accumulate(np.where(np.append(same, False), total, np.inf))
    # A stretch [i, k) is dense enough if total[i] <= total[k]: for each end, the first start as low.
    starts = np.searchsorted(-low, -total, "left")
    sizes = np.where(np.insert(same, 0, False), np.arange(n + 1) - starts, 0)
    k = int(sizes.argmax())
    return (int(starts[k]), int(sizes[k])) if sizes[k] > 0 else (0, 0)


def _blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[Items]:
    """The items in blocks of bounded size. The benchmark is the stated query set; it passes the driver block by block."""
    ids, words, held = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator(prefetchPartitions=False):
        found = np.concatenate([w for _, w, _ in token_runs(pa.array([row["text"]]))])
        if len(found):
            ids.append(row["item_id"])
            words.append(found)
            held += len(found)
        if held >= block_tokens:
            yield Items(ids, words)
            ids, words, held = [], [], 0
    if ids:
        yield Items(ids, words)


def contamination(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, overlap, mismatches): each item a document has a passage of, at its best place.

    Words are runs of letters and digits, A-Z as a-z. Under each fixed mask the hashes of the words it selects are joined
    between all places of documents and items; around a hit, the words along its diagonal are compared, and the longest
    stretch in which four fifths agree counts if it spans 13 words, or the whole of a shorter item. Places are in words.

    The items are the query set: blocks of bounded size go to all tasks, one pass over the documents each, and nothing is
    shuffled, so neither a common passage nor a hot document gathers anywhere. Null texts are empty, items without words
    match nothing, repeated rows are reported each, null ids stay null.
    """
    out = docs.sparkSession.createDataFrame([], OUT)
    for items in _blocks(benchmark, block_tokens):
        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_search(docs, items), OUT))
    return out


def _search(docs: DataFrame, items: Items):
    sent = shared(docs.sparkSession, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for first, words, row in token_runs(b.column(1)):
                for r, item, *rest in sent.value.overlaps(words, row) if len(words) else ():
                    rows.append((ids[first + r], sent.value.ids[item], *rest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_FIELDS)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs, all columns, without the rows that have a passage of an item. Nothing is shuffled.

    Each row is judged by its text alone: null and repeated doc_ids change nothing, null and empty texts stay.
    """
    for items in _blocks(benchmark, block_tokens):
        docs = docs.mapInArrow(_clean(docs, items, docs.columns.index("text")), docs.schema)
    return docs


def _clean(docs: DataFrame, items: Items, text: int):
    sent = shared(docs.sparkSession, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for first, words, row in token_runs(b.column(text)):
                for r, *_ in sent.value.overlaps(words, row) if len(words) else ():
                    keep[first + r] = False
            yield b.filter(pa.array(keep))

    return run


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
