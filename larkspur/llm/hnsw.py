"""A hierarchical navigable small-world graph over unit vectors in numpy: built in batches, searched by many queries in step."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BATCH = 256  # queries that walk together


@dataclass(frozen=True)
class Shape:
    """degree: links of a node on upper layers, twice that on the lowest. build: beam of insertions."""

    degree: int = 12
    build: int = 48
    seed: int = 7


class Graph:
    """Layers of neighbour lists over ``units``, float32 unit vectors of which the first ``n`` are in the graph. Node 0 is the entry."""

    def __init__(self, units: np.ndarray, links: list[np.ndarray], n: int):
        self.units, self.links, self.n = units, links, n

    def _walk(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the beam of each query, best first; -1 where a beam is not full.

        In each step every query opens the best of its beam that it has not opened yet; it is done when none is left.
        """
        links, units = self.links[layer], self.units
        b, width = len(queries), links.shape[1]
        seen = np.zeros((b, len(units) + 1), bool)  # the last column stands for no node
        rows = np.arange(b)
        nodes, sims = np.full((b, beam), -1, np.int32), np.full((b, beam), -np.inf, np.float32)
        closed = np.ones((b, beam), bool)
        nodes[:, 0], sims[:, 0], closed[:, 0] = entries, np.einsum("bd,bd->b", units[entries], queries), False
        seen[rows, entries] = True
        seen[:, -1] = True
        live = rows
        opened = 1 if beam < 8 else 3
        while len(live):
            key = np.where(closed[live], -np.inf, sims[live])
            at = np.argpartition(key, -opened, axis=1)[:, -opened:] if opened < beam else np.argsort(key, axis=1)[:, -opened:]
            good = np.take_along_axis(key, at, axis=1) > -np.inf
            keep = good.any(axis=1)
            live, at, good = live[keep], at[keep], good[keep]
            if not len(live):
                break
            from_ = np.where(good, np.take_along_axis(nodes[live], at, axis=1), -1)
            mark = closed[live]
            np.put_along_axis(mark, at, True, axis=1)
            closed[live] = mark
            near = np.where(from_[:, :, None] >= 0, links[from_], -1).reshape(len(live), opened * width)
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            seen[:, -1] = True
            if opened > 1:  # one node may be reached by two that were opened together
                order = np.sort(np.where(new, near.astype(np.int64) * (opened * width) + np.arange(opened * width), -1), axis=1)
                first = np.diff(order // (opened * width), axis=1, prepend=-2) != 0
                near = np.where(first & (order >= 0), order // (opened * width), -1)
                new = near >= 0
            far = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(new)
            far[r, c] = np.einsum("nd,nd->n", units[near[r, c]], queries[live[r]])
            all_nodes = np.concatenate([nodes[live], near.astype(np.int32)], axis=1)
            all_sims = np.concatenate([sims[live], far], axis=1)
            all_closed = np.concatenate([closed[live], ~new], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            nodes[live], sims[live], closed[live] = (np.take_along_axis(x, best, axis=1) for x in (all_nodes, all_sims, all_closed))
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, axis=1)
        return np.where(sims > -np.inf, np.take_along_axis(nodes, order, axis=1), -1), sims

    def _down_to(self, queries: np.ndarray, layer: int) -> np.ndarray:
        at = np.zeros(len(queries), np.int32)
        for upper in range(len(self.links) - 1, layer, -1):
            at = self._walk(queries, at, upper, 2)[0][:, 0]
        return at

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query on the lowest layer, best first."""
        found = [self._walk(q, self._down_to(q, 0), 0, min(beam, self.n)) for q in (queries[i : i + _BATCH] for i in range(0, len(queries), _BATCH))]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def within(self, queries: np.ndarray, least: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all that the beams reach at the query's similarity ``least`` or more.

        A beam whose last is within ``least`` too is widened until it isn't or holds the whole graph, so nothing caps the number of finds.
        """
        who, rows, cols = np.arange(len(queries)), [], []
        while len(who):
            nodes, sims = self.nearest(queries[who], beam)
            full = (nodes[:, -1] >= 0) & (sims[:, -1] >= least[who]) & (beam < self.n)
            r, c = np.nonzero((sims >= least[who, None]) & (nodes >= 0) & ~full[:, None])
            rows.append(who[r])
            cols.append(nodes[r, c])
            who, beam = who[full], beam * 4
        return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int32), *cols])


def _spread(units: np.ndarray, of: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of the candidates of each node (best first, -1 for none): one is taken unless a taken one is nearer to
    it than the node is, and what is left of the list is filled with the best of the others."""
    b, m = near.shape
    vectors = units[near]
    among = np.einsum("bid,bjd->bij", vectors, vectors)
    taken, there = np.zeros((b, m), bool), (near >= 0) & (near != of[:, None])
    for j in range(m):
        taken[:, j] = there[:, j] & (taken.sum(axis=1) < degree) & ~(taken & (among[:, :, j] > sims[:, [j]])).any(axis=1)
    rank = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(there, rank, axis=1), np.take_along_axis(near, rank, axis=1), -1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


def _link_back(units: np.ndarray, links: np.ndarray, new: np.ndarray, degree: int) -> None:
    """Neighbours of new nodes get links to them; lists that overflow are chosen anew."""
    a, b = np.repeat(new, degree), links[new].ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    targets, start, counts = np.unique(b, return_index=True, return_counts=True)
    for lo in range(0, len(targets), 512):
        t, s, n = targets[lo : lo + 512], start[lo : lo + 512], counts[lo : lo + 512]
        more = np.full((len(t), int(n.max())), -1, np.int32)
        slot = np.arange(more.shape[1]) < n[:, None]
        more[slot] = a[s[0] : s[0] + int(n.sum())]
        held = np.concatenate([links[t], more], axis=1)
        sims = np.where(held >= 0, np.einsum("bmd,bd->bm", units[held], units[t]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * degree]
        held, sims = np.take_along_axis(held, order, axis=1), np.take_along_axis(sims, order, axis=1)
        links[t] = _spread(units, t, held, sims, degree)


def _leaders(peers: np.ndarray, merge: float) -> np.ndarray:
    """For each vector itself, or an earlier one that leads and is as near as ``merge``."""
    of = np.arange(len(peers))
    close = np.tril(peers >= merge, -1)
    for i in np.flatnonzero(close.any(axis=1)).tolist():
        near = np.flatnonzero(close[i] & (of == np.arange(len(of))))
        if len(near):
            of[i] = near[0]
    return of


def build(units: np.ndarray, merge: float, shape: Shape = Shape()) -> tuple[Graph, np.ndarray, np.ndarray]:
    """(graph, leaders, node of each row): rows as near as ``merge`` to a node that is there already follow it, others become nodes.

    Rows come in batches that grow with what is there, each linked among itself too, so a group of near copies of any size
    is one node or a few, not a dense part of the graph. leaders are the rows of the nodes.
    """
    n = len(units)
    rng = np.random.default_rng(shape.seed)
    levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(shape.degree)).astype(np.int64), 8)
    levels[:1] = levels.max(initial=0)
    links = [np.full((n, 2 * shape.degree if layer == 0 else shape.degree), -1, np.int32) for layer in range(int(levels.max(initial=0)) + 1)]
    graph = Graph(np.zeros_like(units), links, 0)
    leaders, node_of, at = [], np.full(n, -1, np.int32), 0
    while at < n:
        rows = np.arange(at, min(n, at + max(1, min(at // 2, 512))))
        at += len(rows)
        if graph.n:
            best, sims = graph.nearest(units[rows], 16)
            near = sims[:, 0] >= merge
            node_of[rows[near]] = best[near, 0]
            rows = rows[~near]
        if not len(rows):
            continue
        own = units[rows] @ units[rows].T
        np.fill_diagonal(own, -np.inf)
        of = _leaders(own, merge)
        lead = np.flatnonzero(of == np.arange(len(of)))
        done, new = graph.n, np.arange(graph.n, graph.n + len(lead), dtype=np.int32)
        place = np.full(len(rows), -1, np.int32)
        place[lead] = new
        node_of[rows] = place[of]
        leaders.append(rows[lead])
        graph.units[new] = units[rows[lead]]
        own = own[np.ix_(lead, lead)]
        for layer in range(len(links)):
            members = np.flatnonzero(levels[new] >= layer)
            if not len(members):
                break
            _insert(graph, links[layer], new[members], own[np.ix_(members, members)], layer, done, shape)
        graph.n = done + len(lead)
    graph.units, graph.links = graph.units[: graph.n], [x[: graph.n] for x in links]
    return graph, np.concatenate([np.empty(0, np.int64), *leaders]), node_of


def _insert(graph: Graph, links: np.ndarray, new: np.ndarray, peers: np.ndarray, layer: int, done: int, shape: Shape) -> None:
    """Links new nodes on a layer with what a search of the graph finds and with each other."""
    k = min(len(new), shape.build)
    top = np.argpartition(-peers, k - 1, axis=1)[:, :k]
    near, sims = new[top], np.take_along_axis(peers, top, axis=1)
    if done:
        found = []
        for lo in range(0, len(new), _BATCH):
            vectors = graph.units[new[lo : lo + _BATCH]]
            found.append(graph._walk(vectors, graph._down_to(vectors, layer), layer, min(shape.build, done)))
        near = np.concatenate([near, np.concatenate([f[0] for f in found])], axis=1)
        sims = np.concatenate([sims, np.concatenate([f[1] for f in found])], axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")[:, : shape.build]
    near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
    degree = links.shape[1]
    links[new] = _spread(graph.units, new, np.where(sims > -np.inf, near, -1), sims, degree)
    _link_back(graph.units, links, new, degree)
