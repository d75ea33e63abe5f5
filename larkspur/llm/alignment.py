"""Cross-tokenizer alignment: two tokenizations of each text, cut into groups where both end a token, with pair counts of the corpus.

Both tokenizers treat a space that follows a character that is no white space as the start of something new: no byte-level
piece of the one and no piece of the other runs over it. Texts are therefore cut there into segments, and the tokens, groups
and links of a text are those of its segments one after the other. Each task works on blocks of whole texts: the distinct
segments of a block are tokenized once, and DuckDB joins their token interval tables. Tests hold the result against both
tokenizers run over whole texts.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared, written

#: Where a text may be cut: before a space after a character that is no white space.
CUT = re.compile(r"(?<=\S)(?= )")
#: Fixed value: how the byte-level tokenizer splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Params:
    """Files of the two tokenizers, read by the driver and sent to all tasks (2 MB), and the text of a block in bytes.

    A text longer than a block is a block of its own: texts are never cut between tasks.
    """

    byte_level: str = "/opt/tokenizers/byte_bpe_50k.json"
    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"
    block_bytes: int = 6 << 20


class Tokenizers:
    """Both tokenizers without special tokens, and the bytes of each of their tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken

        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in kept]
        of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}
        read = json.loads(byte_level)
        special = {t["id"] for t in read.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in token): i for token, i in read["model"]["vocab"].items() if i not in special}
        self._a = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self._b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        piece, self._space = self._b.id_to_piece, self._b.piece_to_id("▁")
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self._b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self._b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int32) for t in (self.a_bytes, self.b_bytes))

    def a(self, segments: list[str]) -> list[list[int]]:
        return [self._a.encode_ordinary(s) for s in segments]

    def b(self, segments: list[str]) -> list[list[int]]:
        """Every segment starts with a space, which the tokenizer adds by itself, though not to nothing: so a lone space is its piece."""
        ids = self._b.encode([s[1:] for s in segments], num_threads=1)
        return [x or [self._space] for x in ids]


@lru_cache(maxsize=1)
def _tokenizers(byte_level: bytes, pieces: bytes) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


def _files(spark: SparkSession, params: Params) -> Broadcast:
    return shared(spark, tuple(Path(os.path.realpath(p)).read_bytes() for p in (params.byte_level, params.pieces)))


def _intervals(ids: list[list[int]], sizes: np.ndarray) -> dict[str, np.ndarray]:
    """One row per token: its segment, id and byte range on an axis on which the segments follow each other."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
    stop = np.cumsum(sizes[flat], dtype=np.int32)
    return {"seg": np.repeat(np.arange(len(ids), dtype=np.int32), counts), "i": np.arange(len(flat), dtype=np.int32), "id": flat, "s": stop - sizes[flat], "e": stop}


#: Groups end where tokens of both end: running sums of those ends number the groups of either side alike. The B token that
#: holds an A token's start is found by ASOF join; B tokens that start inside an A token by a range join. That is all overlaps.
_SEGMENTS = """
create table ends as select a.e from a join b on a.e = b.e;
create table ga as select i, coalesce(sum((ends.e is not null)::int) over (order by i rows between unbounded preceding and 1 preceding), 0)::int as g from a left join ends on a.e = ends.e;
create table gb as select i, coalesce(sum((ends.e is not null)::int) over (order by i rows between unbounded preceding and 1 preceding), 0)::int as g from b left join ends on b.e = ends.e;
create table link as
  select a.seg, a.id as a, b.id as b from a asof join b on a.s >= b.s
  union all
  select a.seg, a.id, b.id from (select * from b anti join a on b.s = a.s) b join (select * from a where s + 1 < e) a on b.s > a.s and b.s < a.e;
create table pair as select row_number() over (order by a, b) - 1 as k, a, b from (select distinct a, b from link);
"""


def _good(segments: list[str], tokenized: list[list[list[int]]], tables: list[list[bytes]]) -> np.ndarray:
    """Whether the tokens of a segment spell it, by both tokenizers."""
    whole = "".join(segments).encode()
    good = np.ones(len(segments), bool)
    for ids, table in zip(tokenized, tables, strict=True):
        if b"".join(map(table.__getitem__, chain.from_iterable(ids))) != whole:
            good &= np.array([b"".join(table[i] for i in x) == s.encode() for x, s in zip(ids, segments, strict=True)], bool)
    return good


class _Block:
    """Texts of a block and its DuckDB tables: what both tokenizers make of the distinct segments, and how they overlap."""

    def __init__(self, texts: list[str], t: Tokenizers):
        number = defaultdict(count().__next__)
        coded = [np.fromiter(map(number.__getitem__, CUT.split(" " + x)), np.int32) if x else np.empty(0, np.int32) for x in texts]
        segments, sizes = list(number), np.fromiter(map(len, coded), np.int64, len(coded))
        codes, docs = np.concatenate([np.empty(0, np.int32), *coded]), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        ids = [t.a(segments), t.b(segments)]
        good = _good(segments, ids, [t.a_bytes, t.b_bytes])
        if not good.all():
            whole = np.ones(len(texts), bool)
            whole[docs[~good[codes]]] = False
            codes, docs = codes[whole[docs]], docs[whole[docs]]
            good &= np.bincount(codes, minlength=len(segments)) > 0
            ids = [[x if ok else [] for x, ok in zip(side, good.tolist(), strict=True)] for side in ids]
        self.segments, self.codes = len(segments), codes
        self.sizes = np.bincount(docs, minlength=len(texts))
        self.sides = [_intervals(ids.pop(0), t.a_sizes), _intervals(ids.pop(0), t.b_sizes)]
        del number, segments, coded
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "2GB", "temp_directory": "", "preserve_insertion_order": False})
        for name, frame in (("a", self.sides[0]), ("b", self.sides[1]), ("occurrence", {"doc": docs, "seg": codes})):
            self.con.register("incoming", pa.table(frame))
            self.con.execute(f"create table {name} as select * from incoming")
            self.con.unregister("incoming")
        self.con.execute(_SEGMENTS)

    def frame(self, query: str) -> dict[str, np.ndarray]:
        return {k: np.asarray(v) for k, v in self.con.execute(query).fetchnumpy().items()}

    def per_text(self, of_segment: np.ndarray) -> pa.Array:
        """Sums over the segments of each text."""
        ends = np.concatenate([[0], np.cumsum(of_segment[self.codes])])
        stop = np.cumsum(self.sizes)
        return pa.array(ends[stop] - ends[stop - self.sizes])

    def counts(self) -> list[pa.Array]:
        """n_a, n_b, n_groups and n_links of each text."""
        sides = [np.bincount(x["seg"], minlength=self.segments) for x in self.sides]
        self.of_a, self.of_b = (self.frame(f"select g from {x} order by i")["g"] for x in ("ga", "gb"))
        first = np.diff(self.of_a, prepend=-1) != 0
        links = self.frame("select seg, count(*) as n from link group by seg")
        n_links = np.zeros(self.segments, np.int64)
        n_links[links["seg"]] = links["n"]
        return [self.per_text(x) for x in (*sides, np.bincount(self.sides[0]["seg"][first], minlength=self.segments), n_links)]

    def groups(self) -> Iterator[bytes]:
        """The groups of each text. After counts()."""
        token = np.concatenate([self.of_a * 2, self.of_b * 2 + 1])  # by group, then by side
        order = np.argsort(token, kind="stable")
        token, ids, segs = token[order], np.concatenate([x["id"] for x in self.sides])[order], np.concatenate([x["seg"] for x in self.sides])[order]
        new = np.diff(token, prepend=-1) != 0
        most = len(str(int(ids.max(initial=0))))
        wide = np.empty((len(ids), 1 + most), np.uint8)  # a separator and digits, of which leading zeros are left out
        wide[:, 0] = np.where(new, np.where(token % 2 == 1, ord("|"), ord(";")), ord(","))
        left, digits = ids.copy(), np.ones(len(ids), np.int8)
        for at in range(most, 0, -1):
            wide[:, at] = left % 10 + 48
            left //= 10
            digits += left > 0
        kept = np.arange(1 + most, dtype=np.int8) > most - digits[:, None]
        kept[:, 0] = True
        data = wide[kept].tobytes()
        stop = np.cumsum(np.bincount(segs, weights=digits + 1, minlength=self.segments).astype(np.int64)).tolist()
        spelled = [data[i + 1 : j] for i, j in zip([0, *stop], stop, strict=False)]
        codes, at = self.codes.tolist(), 0
        for n in self.sizes.tolist():
            yield b";".join([spelled[c] for c in codes[at : at + n]])
            at += n


def _packed(x: np.ndarray, kind: type) -> bytes:
    """Numbers as compressed bytes, low bytes before high ones."""
    return zlib.compress(np.ascontiguousarray(x, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes(), 1)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(size, -1).T).tobytes(), kind)


_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, a array<int>, b array<int>, n array<long>, seg_sizes binary, seg_pairs binary, doc_sizes binary, doc_segs binary, doc_counts binary"


def _aligned(ids: pa.Array, texts: list[str], t: Tokenizers) -> pa.RecordBatch:
    """The row of a block: what is known of its texts, its pairs with their counts, and which pairs texts have, by segment."""
    block = _Block(texts, t)
    cols = [ids, *block.counts(), pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in block.groups()], pa.string())]
    pairs = block.frame("select k, a, b, sum(n)::bigint as n from link join pair using (a, b) join (select seg, count(*) as n from occurrence group by seg) using (seg) group by k, a, b order by k")
    links = block.frame("select seg, k from link join pair using (a, b) order by seg, k")
    used = block.frame("select doc, seg, count(*) as n from occurrence group by doc, seg order by doc, seg")
    block.con.close()
    # Segments are numbered anew: those with links, in order. Numbers of segments and of pairs are kept as steps.
    segs, sizes = np.unique(links["seg"], return_counts=True)
    step = lambda x: np.diff(x.astype(np.int64), prepend=0).astype(np.int32)
    cols += [pa.array(pairs["a"]), pa.array(pairs["b"]), pa.array(pairs["n"])]
    rows = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in cols]
    rows += [pa.array([x], pa.binary()) for x in (_packed(sizes, np.int32), _packed(step(links["k"]), np.int32), _packed(np.bincount(used["doc"], minlength=len(texts)), np.int32), _packed(step(np.searchsorted(segs, used["seg"])), np.int32), _packed(used["n"], np.int32))]
    number = int.from_bytes(os.urandom(8), "little", signed=True)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *rows], names=[x.strip().split(" ")[0] for x in _BLOCK.split(",")])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(doc ids, texts) of whole documents, up to about ``size`` bytes of text; null is empty.

    Blocks are millions of short lists without cycles, so this worker looks for cycles between blocks only.
    """
    gc.disable()
    ids, texts, held = [], [], 0
    for batch in batches:
        lengths = batch.column(1).cast(pa.large_binary())
        for i, n in enumerate(pc.binary_length(lengths).fill_null(0).to_pylist()):
            if texts and held + n > size:
                yield pa.array(ids, pa.int64()), texts
                ids, texts, held = [], [], 0
                gc.collect()
            ids.append(batch.column(0)[i].as_py())
            texts.append(batch.column(1)[i].as_py() or "")
            held += n
    if texts:
        yield pa.array(ids, pa.int64()), texts


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, groups): the groups themselves, ``a1,a2|b1;a3|b2,b3``, '' for texts without tokens."""
    files = _files(docs.sparkSession, params)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(*files.value)
        for ids, texts in _blocks(batches, params.block_bytes):
            block = _Block(texts, t)
            block.counts()
            block.con.close()
            spelled = pa.array([x.decode() for x in block.groups()], pa.string())
            yield pa.RecordBatch.from_arrays([ids, spelled], names=["doc_id", "groups"])

    return _rows(docs).mapInArrow(work, "doc_id long, groups string")


def _totals(blocks: DataFrame) -> DataFrame:
    """(of, k, total, best): for each pair of a block how many links of the corpus have it, and whether no A id has more with its B id."""
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("k", "p")).select("block", "k", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.n").alias("n"))
    counts = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")), "pairs")
    top = counts.groupBy("b").agg(F.max("total").alias("top"))  # a row for each entry of the vocabulary at most
    marked = counts.join(F.broadcast(top), "b").select("a", "b", "total", (F.col("total") == F.col("top")).alias("best"))
    return pairs.select(F.col("block").alias("of"), "k", "a", "b").join(marked, ["a", "b"]).select("of", "k", "total", "best")


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(block: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of a block with the sums of what their links' pairs count in the corpus."""
    row = {c: block[c][0] for c in block.column_names}
    get = lambda c: _unpacked(row[c].as_py(), np.int32).astype(np.int64)
    k = totals["k"].to_numpy()
    total, best = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    total[k], best[k] = totals["total"].to_numpy(), totals["best"].to_numpy(zero_copy_only=False)
    seg_sizes, doc_sizes, n = get("seg_sizes"), get("doc_sizes"), get("doc_counts")
    links, segs = np.cumsum(get("seg_pairs")), np.cumsum(get("doc_segs"))

    def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(values)])
        stop = np.cumsum(sizes)
        return ends[stop] - ends[stop - sizes]

    out = {c: row[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    for name, value in (("n_best", best), ("count_sum", total)):
        out[name] = pa.array(sums(sums(value[links], seg_sizes)[segs] * n, doc_sizes))
    return pa.table(out | {"groups_sha256": row["sha"].values})


def align(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of docs: how both tokenizations of its text align, and what its links count in the whole corpus.

    doc_id, n_a and n_b (tokens), n_groups, n_links (pairs of overlapping tokens), n_best (links whose pair no other pair of
    the same B id outnumbers), count_sum (over links) and groups_sha256 of what groups() returns. Texts that are null or
    empty, or that the tokens of one side don't spell (such as one with U+2581), have zeros and ''. Repeated rows and null
    doc_ids get a row each; an empty table gives none; other columns of docs play no part.

    Pairs are counted by block first, so a pair that every text has is shuffled once a block, both for the counts and for
    their way back; the sums of a block's documents are made where its counts come back.
    """
    files = _files(docs.sparkSession, params)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(*files.value)
        for ids, texts in _blocks(batches, params.block_bytes):
            yield _aligned(ids, texts, t)

    blocks = written(_rows(docs).mapInArrow(work, _BLOCK), "aligned")
    known = blocks.drop("a", "b", "n").groupBy("block")
    return known.cogroup(_totals(blocks).groupBy("of")).applyInArrow(_scored, _OUT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
