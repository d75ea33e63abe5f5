"""Suffix arrays by induced sorting, in numpy: whole buckets are induced at once."""

from __future__ import annotations

import numpy as np

ALPHABET = 258  # 0 ends the text, 1 stands between its parts, a byte b is b + 2


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one."""
    step = np.append(np.sign(s[1:].astype(np.int32) - s[:-1]), 1)
    at = np.where(step != 0, np.arange(len(s)), len(s))
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _deal(buckets: list[list[np.ndarray]], s: np.ndarray, at: np.ndarray) -> None:
    """Append positions to the buckets of their first characters, in the order given."""
    if not len(at):
        return
    c = s[at]
    order = np.argsort(c, kind="stable")
    at, c = at[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    for part, first in zip(np.split(at, cuts), c[np.append(0, cuts)].tolist(), strict=True):
        buckets[first].append(part)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of leftmost-smaller ones induces."""
    start, larger, smaller = ([[] for _ in range(ALPHABET)] for _ in range(3))
    _deal(start, s, lms)
    done: list[np.ndarray] = []
    for c in range(ALPHABET):
        at, out = _joined(larger[c]), []
        while len(at):
            out.append(at)
            before = at[at > 0] - 1
            before = before[~small[before]]
            here = s[before] == c
            _deal(larger, s, before[~here])
            at = before[here]
        done.append(_joined(out))
        at = _joined(start[c])
        _deal(larger, s, at[at > 0] - 1)
    smaller[0].append(np.array([len(s) - 1]))
    order: list[np.ndarray] = []
    for c in range(ALPHABET - 1, -1, -1):
        at, out = _joined(smaller[c]), []
        while len(at):
            out.append(at)
            before = at[at > 0] - 1
            before = before[small[before]]
            here = s[before] == c
            _deal(smaller, s, before[~here])
            at = before[here]
        at = done[c][::-1]
        before = at[at > 0] - 1
        _deal(smaller, s, before[small[before]])
        order += [*out, at]
    return _joined(order)[::-1]


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """A number for each leftmost-smaller substring, in text order; equal substrings share one and order is kept."""
    index = np.zeros(len(s), np.int64)
    index[lms] = np.arange(len(lms))
    size = np.append(np.diff(lms) + 1, 1)[index[ordered]]
    a, b = ordered[:-1], ordered[1:]
    same = size[:-1] == size[1:]
    live, t = np.flatnonzero(same), 0
    while len(live):
        bad = s[a[live] + t] != s[b[live] + t]
        same[live[bad]] = False
        t += 1
        live = live[~bad]
        live = live[size[live] > t]
    names = np.empty(len(lms), np.int64)
    names[index[ordered]] = np.append(0, np.cumsum(~same))
    return names


def suffix_array(s: np.ndarray, depth: int = 128) -> np.ndarray:
    """The order of the suffixes of s, which ends with its only 0, by ``depth`` characters at least.

    Suffixes are classified, leftmost-smaller substrings are sorted by one induction and named, the text of their names is
    sorted in turn, and a second induction gives all suffixes. Buckets of bytes are induced whole; the text of names has too
    many letters for that, so its suffixes are sorted by ranks of doubling lengths until they differ or hold ``depth``
    characters (a name advances by two or more). Suffixes that agree that far stand in any order.
    """
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sorted_once = _induce(s, small, lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    rank = _names(s, lms, sorted_once[is_lms[sorted_once]])
    k, n = 1, len(lms)
    order = np.argsort(rank)
    while 2 * k <= depth and int(rank[order[-1]]) < n - 1:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)  # equal keys share a rank, so any order of them does
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        k *= 2
    return _induce(s, small, lms[order])


def permuted_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, how many characters its suffix shares with the one before it in the order, up to a 0 or 1.

    Where the characters before both suffixes agree and end no part, the length is one less than at the position before; only the other
    places are compared.
    """
    n = len(s)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    fresh = (before <= 0) | (i == 0) | (s[i - 1] <= 1) | (s[i - 1] != s[before - 1]) | (before[i - 1] != before - 1)
    shared = np.zeros(n, np.int64)
    live, t = np.flatnonzero(fresh & (before >= 0)), 0
    while len(live):
        a = s[live + t]
        live = live[(a > 1) & (a == s[before[live] + t])]
        t += 1
        shared[live] = t
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.maximum(shared[last] - (i - last), 0)
