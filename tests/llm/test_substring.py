import hashlib
import random

import numpy as np
import pytest

from larkspur.llm import substring_dedup as sd
from larkspur.llm.suffix import permuted_prefixes, suffix_array


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_against_sorting(seed):
    rng = np.random.default_rng(seed)
    letters = (2, 3, 30, 257)[seed % 4]
    s = np.append(rng.integers(1, letters + 1, 400), 0).astype(np.int16)
    if seed >= 6:
        s = np.concatenate([s[:90], s[:90], s[50:80], np.full(60, 1), s])[:-1]
        s = np.append(s[s != 0], 0).astype(np.int16)
    order = suffix_array(s, depth=1 << 12)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert order.tolist() == want
    shared = permuted_prefixes(s, order)
    for a, b in zip(want, want[1:]):
        n = 0
        while s[a + n] > 1 and s[a + n] == s[b + n]:
            n += 1
        assert shared[b] == n


def brute(docs):
    first, out = {}, {}
    for doc, text in sorted(docs):
        data, gone = text.encode(), set()
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in first:
                gone.update(range(i, i + 100))
            else:
                first[w] = 1
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        out[doc] = (len(data), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, run = text(40), "-" * 500
    base = [text(rng.randint(5, 120)) for _ in range(12)]
    docs = []
    for i in range(90):
        t = rng.choice(base)
        k = rng.random()
        if k < 0.3:
            w = t.split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif k < 0.5:
            t = text(12) + common + text(12)
        elif k < 0.6:
            t = text(8) + run[: rng.randint(90, 500)] + text(8)
        elif k < 0.7:
            t = t[rng.randrange(len(t)) :] + t
        docs.append((rng.randrange(10_000) * 100 + i, t))
    return docs + [(5, ""), (6, "x" * 99), (7, "x" * 100), (8, "x" * 101)]


@pytest.mark.parametrize("seed,hot,piece", [(1, 1 << 11, 1 << 20), (2, 3, 1 << 20), (3, 1 << 11, 150)])
def test_against_brute_force(spark, monkeypatch, seed, hot, piece):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "_PIECE", piece)
    docs = corpus(seed)
    got = sd.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(docs)


def test_nulls_and_repeated_rows(spark):
    t = "".join(chr(97 + i % 26) + str(i) for i in range(90))
    rows = [(None, t, 1), (3, t, 1), (3, t, 1), (3, "other", 1), (9, None, 1), (None, None, 1)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, tie int")).collect())
    n = len(t)
    assert got == sorted([("None", n, 0, 0), ("3", n, n, 1), ("3", n, n, 1), ("3", 5, 0, 0), ("9", 0, 0, 0), ("None", 0, 0, 0)])
    assert sd.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_find_the_anchors_of_the_whole(monkeypatch):
    text = np.frombuffer(b" ".join(str(i * i).encode() for i in range(3000)) + b"Of " * 900, np.uint8)
    whole = next(sd._pieces(text))
    monkeypatch.setattr(sd, "_PIECE", 777)
    parts = list(sd._pieces(text))
    assert len(parts) > 10
    for name in ("pos", "g", "c", "start", "end"):
        assert np.unique(np.concatenate([getattr(p, name) for p in parts])).tolist() == np.unique(getattr(whole, name)).tolist()


def test_only_what_repeats_is_sorted():
    """Parts are cut to the strings that are there twice, and those without any are left out."""
    rng = np.random.default_rng(3)
    text = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    shared = text(110)
    parts = [text(160), text(20) + shared + text(30), text(50), text(40) + shared + text(10), text(99)]
    which, start, cut = sd._twice(np.array([7, 100, 5, 200, 0]), parts)
    assert (which.tolist(), start.tolist(), cut) == ([1, 3], [120, 240], [shared, shared])
    spans = sd.repeated_spans(np.array([9, 1, 9, 4, 9]), np.zeros(5, int), np.array([7, 100, 5, 200, 0]), parts)
    assert [x.tolist() for x in spans] == [[4], [0], [240], [350]]
