"""A bounded pool of unit vectors that keeps its first members and drops what is redundant."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Pool:
    cap: int = 10
    anchors: int = 3
    dedup: float = 0.95
    vectors: list = field(default_factory=list)
    anchored: list = field(default_factory=list)

    def best(self, v: np.ndarray) -> float | None:
        return float(max(u @ v for u in self.vectors)) if self.vectors else None

    def write(self, v: np.ndarray) -> str:
        """'duplicate', 'full' (all members are anchors), 'added' or 'replaced' (the member nearest to another one left)."""
        if any(float(u @ v) > self.dedup for u in self.vectors):
            return "duplicate"
        outcome = "added"
        if len(self.vectors) >= self.cap:
            free = [i for i, a in enumerate(self.anchored) if not a]
            if not free:
                return "full"
            m = np.stack(self.vectors)
            near = m @ m.T
            np.fill_diagonal(near, -np.inf)
            out = max(free, key=lambda i: (near[i].max(), -i))
            del self.vectors[out], self.anchored[out]
            outcome = "replaced"
        self.vectors.append(v)
        self.anchored.append(sum(self.anchored) < self.anchors)
        return outcome
