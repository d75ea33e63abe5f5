import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import golomb
from larkspur.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from larkspur.llm.simhash import drop_near_duplicates, near_duplicates

DOCS = "doc_id long, text string, lang string, kept string, h int"


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_golomb_round_trip(n):
    low, width = 1 << 63, 1 << 60
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(low, low + width, n, dtype=np.uint64))
    k, code = golomb.encode(v, low, width)
    assert (golomb.decode(code, n, k, low) == v).all()


def _docs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a b c", "", None, "x" * 300_000, f"only {i}", "Same é́", "tie"]), "en", "clash", i) for i in range(300)]
    rows += [(7, "tie", None, None, None), (7, "tie", None, None, None), (None, "tie", None, None, None), (None, "lonely null", None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS)


def _exact(rows):
    keep, size = {}, {}
    for i, t, *_ in rows:
        t = t or ""
        keep[t] = max(keep.get(t, -(1 << 63)), -(1 << 63) if i is None else i)
        size[t] = size.get(t, 0) + 1
    return sorted((str(i), str(None if keep[t or ""] == -(1 << 63) else keep[t or ""]), size[t or ""]) for i, t, *_ in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_against_brute_force(spark, weak):
    rows, docs = _docs(spark)
    hashed = F.length("t").cast("long") * F.lit(1 << 40) if weak else None  # every length collides
    got = exact_duplicates(docs, fingerprint=hashed, owners=3, block_rows=40).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == _exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert len(drop_exact_duplicates(docs.where("doc_id <> 7")).collect()) == len({t or "" for i, t, *_ in rows if i not in (7, None)})


def test_exact_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def _fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("the of And tion er on in é st".split()) + rng.choice("abcdefgh") for _ in range(60)) for _ in range(25)]
    texts = [None, "", " \t", "one", "two words", "É İx"]
    for b in base:
        texts += [b, b, b.upper()] + [" ".join(w if rng.random() > 0.01 else "new" for w in b.split(" ")) for _ in range(8)]
    texts.append(" ".join(f"w{i}" for i in range(70_000)))
    rows = list(enumerate(texts))
    fps = [_fp(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in range(len(texts))}
    kept = {r.doc_id for r in drop_near_duplicates(docs).collect()}
    assert kept == {find(i) for i in range(len(texts))}


def test_links_miss_nothing(spark):
    from larkspur.llm.simhash import links

    rng = random.Random(9)
    fps = set()
    for _ in range(150):
        f = rng.getrandbits(64)
        fps.add(f)
        for d in (1, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(64)}  # large buckets
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in links(spark.createDataFrame(signed, "fp long")).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in got)

    def classes(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return sorted(sorted(f for f in fps if find(f) == r) for r in {find(f) for f in fps})

    assert classes(got) == classes((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3)


def test_simhash_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in near_duplicates(docs).collect()) == [("4", 4), ("4", 4), ("9", 9), ("None", 4)]
    assert near_duplicates(docs.limit(0)).collect() == []
