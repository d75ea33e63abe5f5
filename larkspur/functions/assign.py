"""One-to-one assignment."""

from __future__ import annotations

import numpy as np

INFEASIBLE = 1e6


def solve(cost: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of least total cost, as many as the shorter side has, by shortest augmenting paths with potentials."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in solve(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        dist, via, closed = cost[row] - row_price[row] - col_price, np.full(m, -1), np.zeros(m, bool)
        while True:
            j = int(np.where(closed, np.inf, dist).argmin())
            closed[j] = True
            if owner[j] < 0:
                break
            r = owner[j]
            through = dist[j] + cost[r] - row_price[r] - col_price
            better = ~closed & (through < dist - 1e-12)
            dist[better], via[better] = through[better], j
        shift = dist[j]
        for k in np.flatnonzero(closed):
            if k != j:
                row_price[owner[k]] += shift - dist[k]
                col_price[k] -= shift - dist[k]
        row_price[row] += shift
        while j >= 0:
            before = int(via[j])
            owner[j] = owner[before] if before >= 0 else row
            j = before
    return sorted((int(r), j) for j, r in enumerate(owner) if r >= 0)


def greedy(scores: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Pairs taken in descending order of (score, row, column), each row and column once."""
    rows, cols, out = set(), set(), []
    for _, r, c in sorted(scores, reverse=True):
        if r not in rows and c not in cols:
            rows.add(r)
            cols.add(c)
            out.append((r, c))
    return out
