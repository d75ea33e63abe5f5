"""Words of many texts at once as 64-bit numbers, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII letters and digits and all bytes of other letters make up words; A-Z count as a-z.
_IN_WORD = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
#: All bytes but ASCII white space, for words as the contracts define them.
NO_SPACE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_VALUE = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 20  # bytes looked at together
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, breaks: np.ndarray, in_word: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of the bytes; no word runs over one of the breaks (offsets where texts start)."""
    n = len(data)
    inside = in_word[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = breaks[(breaks > 0) & (breaks < n)]
    start[at] = inside[at]
    starts = np.flatnonzero(start)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[at - 1] = inside[at - 1]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(max(n, 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def _cut(data: np.ndarray, at: int, in_word: np.ndarray) -> int:
    """The first place from at on that is not inside a word, or the end."""
    while at < len(data):
        part = ~in_word[data[at : at + 4096]]
        if part.any():
            return at + int(part.argmax())
        at += 4096
    return len(data)


def token_runs(texts: pa.Array, in_word: np.ndarray = _IN_WORD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words, row of each word counted from it): some whole texts at a time. Null is empty.

    Texts come together up to a megabyte; a longer one comes alone, and its words are hashed piece by piece.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _STEP, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        hashes = []
        if stop == row + 1 and hi - lo > 2 * _STEP:
            one, at = data[lo:hi], 0
            while at < len(one):
                to = _cut(one, at + _STEP, in_word)
                hashes.append(word_hashes(one[at:to], np.empty(0, np.int64), in_word)[0])
                at = to
            words = np.concatenate(hashes)
            rows = np.zeros(len(words), np.int64)
        else:
            words, starts, _ = word_hashes(data[lo:hi], offsets[row:stop] - lo, in_word)
            rows = np.searchsorted(offsets[row : stop + 1] - lo, starts, "right") - 1
        yield row, words, rows
        row = stop
