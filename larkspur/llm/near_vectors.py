"""Near-duplicate embeddings: a navigable small-world graph per shard, every vector queries every shard, links verified and joined."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw
from .common import written
from .components import components

_SAFE = 1e-6  # radians: what bounds by angles leave for rounding


@dataclass(frozen=True)
class Params:
    """similarity: links have this cosine or more. shard_bytes: vectors of a shard, as doubles; shards: at least so many.

    merge: vectors within this share of the link's angle of a node follow it. recall: what the audits of a search must
    reach, on ``audited`` vectors each; beam: where beams start. An audit that fails doubles the beam and searches again.
    """

    similarity: float = 0.95
    shard_bytes: int = 64 << 20
    shards: int = 8
    merge: float = 0.75
    recall: float = 0.98
    audited: int = 256
    beam: int = 16

    @property
    def angle(self) -> float:
        return float(np.arccos(self.similarity))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.square(scaled).sum(axis=1, keepdims=True))


class Shard:
    """Vectors of a shard as double unit vectors, their graph, and for each node the rows that follow it, itself first."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray, leaders: np.ndarray, node_of: np.ndarray, graph: hnsw.Graph, beam: int):
        self.ids, self.weights, self.units, self.graph, self.beam = ids, weights, units, graph, beam
        first = leaders[node_of] != np.arange(len(ids))
        self.rows = np.lexsort((first, node_of))  # by node, the leader first
        self.sizes = np.bincount(node_of, minlength=graph.n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.leaders = leaders
        apart = _angles(np.einsum("nd,nd->n", units, units[leaders][node_of]))
        apart[leaders] = 0
        self.radius = np.zeros(graph.n)
        np.maximum.at(self.radius, node_of, apart)

    def members(self, node: int) -> np.ndarray:
        return self.rows[self.starts[node] : self.starts[node] + self.sizes[node]]


def _audited(graph: hnsw.Graph, params: Params) -> tuple[int, float]:
    """(beam, recall): the beam at which nodes are found from vectors at the edge of a link with them."""
    if not graph.n:
        return params.beam, 1.0
    rng = np.random.default_rng(5)
    nodes = np.arange(graph.n) if graph.n <= params.audited else np.sort(rng.choice(graph.n, params.audited, replace=False))
    own = graph.units[nodes]
    noise = rng.standard_normal(own.shape).astype(np.float32)
    noise -= np.einsum("nd,nd->n", noise, own)[:, None] * own
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
    asked = params.similarity * own + np.float32(np.sqrt(1 - params.similarity**2)) * noise
    least, beam = np.full(len(nodes), params.similarity - 1e-3, np.float32), params.beam
    while True:
        q, found = graph.within(asked, least, beam)
        recall = len(np.unique(q[found == nodes[q]])) / len(nodes)
        if recall >= params.recall or beam >= graph.n:
            return beam, recall
        beam *= 2


def _built(params: Params):
    def build(key: tuple, table: pa.Table) -> pa.Table:
        vectors = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        ids, weights = table["node"].to_numpy(), table["weight"].to_numpy()
        order = np.argsort(ids)  # the same graph however the rows came
        ids, weights, vectors = ids[order], weights[order], vectors[order].astype(np.float64)
        graph, leaders, node_of = hnsw.build(_unit(vectors).astype(np.float32), float(np.cos(params.merge * params.angle)))
        beam, recall = _audited(graph, params)
        blobs = [ids.astype("<i8"), weights.astype("<i8"), vectors.astype("<f8"), leaders.astype("<i8"), node_of.astype("<i4")]
        cols = [[key[0].as_py()], [key[1].as_py()], *([x.tobytes()] for x in blobs), [[x.tobytes() for x in graph.links]], [beam], [recall]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.binary()), pa.int32(), pa.float64()), strict=True)], names=[c.split(" ")[0] for c in _INDEX.split(", ")])

    return build


_INDEX = "dim int, shard int, ids binary, weights binary, vectors binary, leaders binary, node_of binary, links array<binary>, beam int, recall double"


def _read(table: pa.Table, i: int) -> Shard:
    row = {c: table[c][i].as_py() for c in table.column_names}
    units = _unit(np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"]))
    leaders, node_of = np.frombuffer(row["leaders"], "<i8"), np.frombuffer(row["node_of"], "<i4")
    links = [np.frombuffer(x, np.int32).reshape(len(leaders), -1) for x in row["links"]]
    graph = hnsw.Graph(units[leaders].astype(np.float32), links, len(leaders))
    return Shard(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["weights"], "<i8"), units, leaders, node_of, graph, row["beam"])


def _asked(a: Shard, b: Shard, params: Params) -> np.ndarray:
    """Pairs of nodes (one of a, one of b) that may hold linked rows, found by queries of a's nodes to b's graph."""
    reach = np.minimum(params.angle + a.radius + b.radius.max(initial=0) + 1e-3, np.pi)
    least = np.cos(reach).astype(np.float32)
    sample = np.arange(0, a.graph.n, max(1, a.graph.n // params.audited))
    there = a.graph.units[sample] @ b.graph.units.T >= least[sample, None]
    beam = b.beam
    while True:
        q, found = b.graph.within(a.graph.units, least, beam)
        if not there.any() or beam >= b.graph.n:
            break
        hit = np.zeros_like(there)
        at = np.full(a.graph.n, -1)
        at[sample] = np.arange(len(sample))
        known = at[q] >= 0
        hit[at[q[known]], found[known]] = True
        if (hit & there).sum() >= params.recall * there.sum():
            break
        beam *= 2
    return np.stack([q, found.astype(np.int64)], axis=1)


class _Forest:
    """Which of n numbers links connect; many links are folded into few now and then."""

    def __init__(self, n: int):
        self.root, self.held, self.a, self.b = np.arange(n), 0, [], []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > 1 << 22:
            self.roots()

    def roots(self) -> np.ndarray:
        """The smallest number that each is connected with."""
        root, none = self.root, np.empty(0, np.int64)
        a, b = np.concatenate([none, *self.a]), np.concatenate([none, *self.b])
        self.held, self.a, self.b = 0, [], []
        while True:
            x, y = root[a], root[b]
            live = x != y
            if not live.any():
                return root
            a, b, x, y = a[live], b[live], x[live], y[live]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]


def _meet(params: Params):
    def meet(table: pa.Table) -> pa.Table:
        order = np.argsort(table["shard"].to_numpy())
        a = _read(table, int(order[0]))
        same = table["lo"][0] == table["hi"][0]
        if not same and len(order) == 1:  # the other shard got no rows
            return pa.table({c: pa.array([], pa.int64()) for c in ("node", "root", "links")})
        b = a if same else _read(table, int(order[1]))
        pairs = _asked(a, b, params)
        if same:
            pairs = np.concatenate([np.sort(pairs, axis=1), np.repeat(np.arange(a.graph.n), 2).reshape(-1, 2)])
        else:
            pairs = np.concatenate([pairs, _asked(b, a, params)[:, ::-1]])
        pairs = np.unique(pairs, axis=0)
        apart = _angles(np.einsum("nd,nd->n", a.units[a.leaders[pairs[:, 0]]], b.units[b.leaders[pairs[:, 1]]]))
        apart[(pairs[:, 0] == pairs[:, 1]) & same] = 0
        reach = a.radius[pairs[:, 0]] + b.radius[pairs[:, 1]]
        pairs, apart, reach = (x[apart - reach <= params.angle + _SAFE] for x in (pairs, apart, reach))
        n = len(a.ids)
        links = [np.zeros(n, np.int64), np.zeros(len(b.ids), np.int64)]
        forest = _Forest(n if same else n + len(b.ids))
        joined = lambda x, y: forest.join(x, y if same else y + n)

        product = a.sizes[pairs[:, 0]] * b.sizes[pairs[:, 1]]
        sure = (apart + reach <= params.angle - _SAFE) & (product > 1)
        for i, j in pairs[sure].tolist():  # all rows of the one link with all of the other, whatever their number
            x, y = a.members(i), b.members(j)
            links[0][x] += b.weights[y].sum()
            if same and i == j:
                links[0][x] -= a.weights[x]
            else:
                links[1][y] += a.weights[x].sum()
            joined(x, np.full(len(x), y[0]))
            joined(np.full(len(y), x[0]), y)
        large = ~sure & (product > 256)
        for i, j in pairs[large].tolist():
            x, y = a.members(i), b.members(j)
            for lo in range(0, len(x), 256):
                for at in range(0, len(y), 1 << 13):
                    part, other = x[lo : lo + 256], y[at : at + (1 << 13)]
                    hit = a.units[part] @ b.units[other].T >= params.similarity
                    if same and i == j:
                        hit &= part[:, None] != other
                    count = hit.astype(np.float64)  # sums of whole numbers, exact up to 2**53
                    links[0][part] += (count @ b.weights[other]).astype(np.int64)
                    if not (same and i == j):
                        links[1][other] += (a.weights[part] @ count).astype(np.int64)
                    r, c = np.nonzero(hit)
                    joined(part[r], other[c])
        small = np.flatnonzero(~sure & ~large)
        for lo in range(0, len(small), 1 << 14):
            some = small[lo : lo + (1 << 14)]
            i, j, p = pairs[some, 0], pairs[some, 1], product[some]
            at = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
            wide = np.repeat(b.sizes[j], p)
            x, y = a.rows[np.repeat(a.starts[i], p) + at // wide], b.rows[np.repeat(b.starts[j], p) + at % wide]
            apart_rows = ~np.repeat((i == j) & same, p) | (x < y)
            x, y = x[apart_rows], y[apart_rows]
            hit = np.einsum("nd,nd->n", a.units[x], b.units[y]) >= params.similarity
            x, y = x[hit], y[hit]
            np.add.at(links[0], x, b.weights[y])
            np.add.at(links[1], y, a.weights[x])
            joined(x, y)
        root = forest.roots()
        ids, n_links = (a.ids, links[0] + links[1]) if same else (np.concatenate([a.ids, b.ids]), np.concatenate(links))
        some = np.flatnonzero((n_links > 0) | (root != np.arange(len(root))))
        return pa.table({"node": pa.array(ids[some]), "root": pa.array(ids[root[some]]), "links": pa.array(n_links[some])})

    return meet


def _valid(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda c: c != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.col("embedding")).alias("vec"))


def index(classes: DataFrame, params: Params = Params()) -> DataFrame:
    """classes(node, vec, weight) -> one row per shard: its vectors, graph, beam and audited recall. Shards hold vectors of one length."""
    per = F.greatest(F.lit(params.shards), F.ceil(F.col("n") * F.col("dim") * 8 / params.shard_bytes)).cast("int").alias("shards")
    sizes = written(classes.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).select("dim", per), "shard-counts")
    many = int(sizes.agg(F.sum("shards")).first()[0] or 1)
    dealt = classes.withColumn("dim", F.size("vec")).join(sizes, "dim").select("dim", F.pmod(F.xxhash64("node"), "shards").cast("int").alias("shard"), "node", "vec", "weight")
    parts = min(8 * many, 1 << 15)  # more than shards, so that few meet in a task
    return dealt.repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInArrow(_built(params), _INDEX)


def near_duplicates(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept; other columns play no part.

    Vectors that are null, zero or hold null or non-finite entries link with nothing: no links, a component of their own,
    kept. Vectors of different lengths don't link. Equal vectors are one node that counts for all of them. Null vec_ids get
    their rows and are never a component_id unless a component has no other (then it is null, and nothing of it is kept);
    repeated ones get a row each. An empty table gives none.

    Every vector's node queries the graph of every shard; both directions of a pair of shards run in one task, so a link
    found from either side counts for both. Links are taken from found nodes by cosines in double precision. Where angles
    prove that all rows of two nodes link, they are counted without being listed; tasks report sums and a spanning forest.
    """
    spark = vectors.sparkSession
    rows = written(_valid(vectors), "vectors")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "vec", "least", "weight"), "vector-classes")
    shards = written(index(classes.select("node", "vec", "weight"), params), "shards")
    most = shards.groupBy("dim").agg(F.max("shard").alias("last"))
    others = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    copies = shards.join(F.broadcast(written(most, "last-shards")), "dim").select("*", others)
    copies = copies.withColumns({"lo": F.least("shard", "other"), "hi": F.greatest("shard", "other")}).drop("other", "last", "recall")
    pairs = int(most.select(F.sum((F.col("last") + 1) * (F.col("last") + 2) / 2)).first()[0] or 1)
    met = copies.repartition(min(4 * pairs, 1 << 15), "dim", "lo", "hi").groupBy("dim", "lo", "hi").applyInArrow(_meet(params), "node long, root long, links long")
    met = written(met, "met")
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "vec", "least", "weight").join(roots, "node", "left").join(counts, "node", "left")
    known = written(known.select("vec", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "linked")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    owners = known.join(least, "root").select(F.col("vec").alias("known"), "n_links", "component_id")
    out = rows.join(owners, rows["vec"] == owners["known"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec").isNull() & F.col("vec_id").isNotNull() | (F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
