"""Sums of many words at once against the buckets of each."""

import time

import numpy as np
import pytest

from larkspur.llm import toxicity as tx


@pytest.mark.parametrize("n_grams", [(3, 4, 5, 6), (1, 2), ()])
def test_sums_of_words(n_grams):
    p = tx.Params(buckets=1 << 10, n_grams=n_grams)
    logits = np.random.default_rng(1).normal(size=p.buckets)
    words = ["a", "of", "word", "größe", "東京都庁", "naïvement", "x" * 40, "_1", "𝒳y", "é"]
    sums, counts = tx.word_sums(words, logits, p)
    for w, s, n in zip(words, sums, counts, strict=True):
        ids = tx.features(w, p)
        assert n == len(ids) and abs(s - sum(logits[i] for i in ids)) < 1e-9


def test_words_are_worked_out_together():
    """Ten thousand words in well under what one after another takes."""
    p, words = tx.Params(), [f"word{i}of{i * 7}" for i in range(10_000)]
    logits = np.zeros(p.buckets)
    tx.word_sums(words[:10], logits, p)
    a = time.process_time()
    tx.word_sums(words, logits, p)
    b = time.process_time()
    for w in words:
        sum(logits[i] for i in tx.features(w, p))
    assert (b - a) * 2 < time.process_time() - b
