from itertools import combinations

import numpy as np
import pytest

from larkspur.llm import decontam


def _wrong(n):
    return (n * 2) // 10


@pytest.mark.parametrize("size", range(13, 26))
def test_masks_fit_every_overlap(size):
    """All placements of the words that may differ, at the ends too: then longer overlaps, cut into such pieces, are hit."""
    fits = [sum(1 << i + at for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for at in range(size - len(m) + 1)]
    for where in combinations(range(size), _wrong(size)):
        bad = sum(1 << i for i in where)
        assert any(not f & bad for f in fits), where


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 20])
def test_items_with_every_allowed_substitution_are_found(size):
    rng = np.random.default_rng(size)
    own = rng.integers(1, 1 << 63, size, dtype=np.uint64)
    places = [w for k in range(_wrong(size) + 1) for w in combinations(range(1, size - 1), k)]
    if len(places) > 400:
        places = [places[i] for i in rng.choice(len(places), 400, replace=False)]
    texts = []
    for where in places:
        text = own.copy()
        text[list(where)] = rng.integers(1, 1 << 63, len(where), dtype=np.uint64)
        texts.append(np.concatenate([rng.integers(1, 1 << 63, 5, dtype=np.uint64), text, rng.integers(1, 1 << 63, 5, dtype=np.uint64)]))
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = {r: rest for r, *rest in decontam.Items([1], [own]).overlaps(np.concatenate(texts), rows)}
    assert got == {r: [0, 5, 0, size, len(where)] for r, where in enumerate(places)}


def test_longest_stretch_is_one_whose_ends_agree():
    same = np.array([0] * 4 + [1] * 12 + [0] * 30 + [1] * 6 + [0] * 2 + [1] * 5, bool)
    assert decontam._segment(same) == (46, 13)
    assert decontam._segment(np.zeros(5, bool)) == (0, 0) and decontam._segment(np.ones(3, bool)) == (0, 3)
