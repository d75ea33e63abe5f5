"""Golomb-Rice codes of sorted 64-bit numbers, with the unary and the binary parts apart so that both decode at once."""

from __future__ import annotations

import math

import numpy as np


def encode(values: np.ndarray, low: int, width: int) -> tuple[int, bytes]:
    """values: sorted uint64 from ``low`` on, in a range of ``width``. Returns the remainder's bits and the code."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(low))
    k = min(63, max(0, int(math.log2(max(1.0, math.log(2) * width / len(values))))))
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def decode(code: bytes, n: int, k: int, low: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    # The unary part ends at its n-th stop; no more than n * k bits and the padding follow.
    stops = np.flatnonzero(bits[: len(bits) - n * k])[:n]
    quotients = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    rest = bits[stops[-1] + 1 : stops[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    gaps = (quotients << np.uint64(k)) | (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)
