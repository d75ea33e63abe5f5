import random

import pyarrow as pa
import pytest

import corpus_pipeline
from larkspur.llm import shingles


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _similar(x, y):
    x, y = _shingles(x), _shingles(y)
    return 10 * len(x & y) >= 8 * len(x | y)


def _near(rng, text, changes):
    words = text.split()
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def test_shingle_sets():
    texts = ["a B c d e f", "A b\tc D e F", "a b c", "", None, " \t", "a b c d e a b c d e a b c d e"]
    sets = [set(s.tolist()) for s in shingles.shingle_sets(pa.array(texts))]
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 1, 5] and sets[0] == sets[1] and sets[3] == sets[4] == sets[5]


@pytest.mark.parametrize("small", [3, 1000])
def test_near_dedup_stage_against_brute_force(spark, monkeypatch, small):
    """Copies at all similarities about 0.8, of short and long texts, a large group, a common passage, null and repeated ids."""
    monkeypatch.setattr(shingles, "MANY", small)
    monkeypatch.setattr(shingles, "BLOCK", small * 200)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", " ", "one", "One", "two words", "a b c d e", "a b c d e f"]
    for size in (12, 30, 64, 64, 200, 600):
        base = " ".join(word() for _ in range(size))
        texts += [base] + [_near(rng, base, 1 + size * c // 100) for c in (0, 1, 2, 3, 4, 5)] + [f"{base} {word()} {word()}"]
    big = " ".join(word() for _ in range(100))
    texts += [_near(rng, big, 1) for _ in range(40)] + [f"{passage} {' '.join(word() for _ in range(9))}" for _ in range(25)]
    ids = [None if i % 7 == 3 else i % 150 for i in range(len(texts))]
    rows = list(zip(ids, range(len(texts)), texts, strict=True))
    rng.shuffle(rows)
    root = {n: n for _, n, _ in rows}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if _similar(x[2], y[2])]
    for x, y in pairs:
        root[find(x[1])] = find(y[1])
    docs = spark.createDataFrame(rows, "doc_id long, n long, text string")
    out = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "")
    assert out.columns == docs.columns
    kept = out.collect()
    assert sorted(find(r.n) for r in kept) == sorted({find(n) for _, n, _ in rows})
    for r in kept:
        of = [i for i, n, _ in rows if find(n) == find(r.n) and i is not None]
        assert r.doc_id == (min(of) if of else None)
    assert corpus_pipeline._near_dedup(spark, docs.limit(0), "").collect() == []


def test_spare_grows_no_faster_than_what_is_shared():
    """What similar_links relies on: of two sets that can be similar, the larger one's spare is covered."""
    m = lambda n: shingles._least_shared(n, 0.8)
    for n in range(1, 3000):
        assert shingles._spare(n, 0.8) + 1 <= m(n)
        for k in range(n, int(n / 0.8) + 1, max(1, n // 50)):
            assert shingles._spare(n, 0.8) + m(k) - m(n) >= shingles._spare(k, 0.8)
