"""LM scores against brute force over exact counts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import lm_score


def _words(text):
    return re.findall("(?:[0-9a-z]|[^\\x00-\\x7f])+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _model(texts):
    words = [_words(t) for t in texts]
    return Counter(w for x in words for w in x), Counter(p for x in words for p in zip(x, x[1:]))


def _loss(words, model, own, size, p):
    """own: the counts to leave out."""
    count, pairs, n = lambda w: model[0][w] - own[0][w], lambda a, b: model[1][a, b] - own[1][a, b], sum(model[0].values()) - sum(own[0].values())
    out = 0.0
    for i, w in enumerate(words):
        alone = (count(w) + p.add) / (n + p.add * (size + 1))
        out -= math.log((pairs(words[i - 1], w) + p.prior * alone) / (count(words[i - 1]) + p.prior) if i else alone)
    return out / max(1, len(words))


@pytest.mark.parametrize("leave_out", [True, False])
def test_scores_against_brute_force(spark, leave_out):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "été", "X9"]
    rows = [(None if i % 11 == 0 else i % 50, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), i % 3 == 0, i % 5 != 0) for i in range(120)]
    rows += [(7, None, True, True), (8, "", None, True), (9, "w1 " * 3000, True, True), (9, "w1 " * 3000, True, True), (10, "never-seen", False, False)]
    p = lm_score.Params(block_bytes=900, owner_bytes=2000)
    docs = spark.createDataFrame([(*r, n, "clash") for n, r in enumerate(rows)], "doc_id long, text string, t boolean, b boolean, block long, rows string")
    target, background = _model(r[1] for r in rows if r[2]), _model(r[1] for r in rows if r[3])
    size = len({*target[0], *background[0]})
    want = []
    for i, text, t, b in rows:
        words = _words(text)
        own, none = _model([text]), (Counter(), Counter())
        a, c = _loss(words, target, own if t and leave_out else none, size, p), _loss(words, background, own if b and leave_out else none, size, p)
        want.append((i is None, i or 0, len(words), a, c, c - a))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lm_score.score(docs, F.col("t"), F.col("b"), leave_out, p).collect()]
    key = lambda r: (*r[:3], *(round(x, 7) for x in r[3:]))
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[:3] == y[:3] and max(abs(u - v) for u, v in zip(x[3:], y[3:], strict=True)) < 1e-9


def test_closer_to_target_scores_higher(spark):
    rng = random.Random(3)
    ours, theirs = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(ours if i < 8 else theirs) for _ in range(40))) for i in range(16)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") < 5).collect()}
    assert min(got[i] for i in range(8)) > max(got[i] for i in range(8, 16))


def test_keys_come_back_from_planes():
    import numpy as np

    for a in (np.empty(0, np.uint64), np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)):
        assert (lm_score._unzip(lm_score._zip(a)) == a).all()
