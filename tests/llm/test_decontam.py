"""Contamination against brute force over all diagonals of all pairs."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import decontam
from larkspur.llm.tokens import token_runs


def _words(t):
    return next(iter([*token_runs(pa.array([t or ""]))]))[1]


def _brute(text, item):
    """The most agreeing words of a stretch on one diagonal that is long and dense enough, by trying all stretches."""
    best = 0
    for shift in range(-len(item) + 1, len(text)):
        a, b = max(0, -shift), min(len(item), len(text) - shift)
        same = (item[a:b] == text[a + shift : b + shift]).tolist()
        for i in range(len(same)):
            for k in range(i + min(decontam.MIN_OVERLAP, len(item)), len(same) + 1):
                good = sum(same[i:k])
                if same[i] and same[k - 1] and good >= decontam.SIMILARITY * (k - i) - 1e-9:
                    best = max(best, good)
    return best


@pytest.mark.parametrize("hits", [5, 1 << 20])
def test_contamination_against_brute_force(spark, monkeypatch, hits):
    monkeypatch.setattr(decontam, "HITS", hits)
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghijklmnopqrst")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 4, 7, 9, 12, 13, 16, 20, 30))] + [(20, "x x x x x x x x x x x x x x x x"), (21, ""), (None, None)]
    docs = []
    for d in range(40):
        _, item = rng.choice(items[:9])
        passage = item.split(" ")
        for i in rng.sample(range(len(passage)), rng.randint(0, len(passage) // 4)):
            passage[i] = rng.choice(["new", word()])
        docs.append((d, " ".join([word() for _ in range(rng.randint(0, 15))] + passage + [word() for _ in range(rng.randint(0, 15))])))
    docs += [(50, "x " * 40), (51, None), (52, ""), (None, items[8][1]), (53, items[7][1]), (53, items[7][1])]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, overlap int")
    got = sorted((str(r.doc_id), r.item_id, r.overlap - r.mismatches) for r in decontam.contamination(table, bench).collect())
    want = []
    for d, t in docs:
        for i, item in items:
            x, y = _words(t), _words(item)
            if len(x) and len(y) and (best := _brute(x, y)):
                want.append((str(d), i, best))
    assert {g[:2] for g in got} == {w[:2] for w in want} and len(got) == len(want)
    kept = decontam.drop_contaminated(table, bench).collect()
    bad = {d for d, _, _ in want}
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted((str(d), t or "") for d, t in docs if str(d) not in bad)


def test_repetitive_texts_take_little():
    item = decontam.Items([1], [np.tile(_words("a b c d"), 50)])
    text = np.tile(_words("a b c d"), 16_000)
    start = time.time()
    found = list(item.overlaps(text, np.zeros(len(text), np.int64)))
    assert [(f[4], f[5]) for f in found] == [(200, 0)] and time.time() - start < 60
