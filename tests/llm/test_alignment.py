"""Alignment against both tokenizers run over whole texts, with tokens, groups and links taken one by one from the definition."""

import hashlib
import json
from collections import Counter, defaultdict

import sentencepiece
from tokenizers import Tokenizer

from larkspur.llm.alignment import Params, align, groups

TEXTS = [
    None, "", " ", "   ", "a", "Hello world, hello World!", "x  y   z \n\n  tab\there\n", "naïve façade 日本語 שלום 👩‍👩‍👧 é",
    "<|endoftext|> <s> </s> <unk>", "one▁two", "▁", "NUL\x00 and \x1f x", "It's we've I'LL don't", "a b 　c   d", "1234567890 12 3.14159",
    "https://example.org/?q=a%20b&c=d", "the cat sat on the mat " * 300, "z" * 5000, "\n".join(f"line {i}" for i in range(200)), "Hello world, hello World!", "\r\n\r\n x\r\n", " leading and trailing ",
]
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def _tables(params):
    t = Tokenizer.from_file(params.byte_level)
    t.encode_special_tokens = True
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    a = {i: bytes(of.get(c, 0) for c in x) for x, i in json.load(open(params.byte_level))["model"]["vocab"].items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=params.pieces)
    b = {i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())}
    return (lambda x: t.encode(" " + x, add_special_tokens=False).ids), a, sp.encode, b


def _plain(rows, params=Params()):
    enc_a, a_bytes, enc_b, b_bytes = _tables(params)
    told, links = [], []
    for _, text in rows:
        ids = (enc_a(text), enc_b(text)) if text else ([], [])
        if text and any(b"".join(t[i] for i in x) != (" " + text).encode() for x, t in zip(ids, (a_bytes, b_bytes), strict=True)):
            ids = ([], [])
        spans = []
        for x, t in zip(ids, (a_bytes, b_bytes), strict=True):
            at, out = 0, []
            for i in x:
                out.append((i, at, at + len(t[i])))
                at += len(t[i])
            spans.append(out)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        parts = []
        for lo, hi in zip([0, *ends], ends, strict=False):
            parts.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans))
        by_b = defaultdict(list)
        for i, s, e in spans[1]:
            by_b[s // 64].append((i, s, e))
            if e // 64 != s // 64:
                by_b[e // 64].append((i, s, e))
        found = [(i, j) for i, s, e in spans[0] for j in (y[0] for y in sorted({(y, z, w) for k in range(s // 64, e // 64 + 1) for y, z, w in by_b[k] if z < e and s < w}))]
        links.append(found)
        told.append((len(ids[0]), len(ids[1]), len(parts), ";".join(parts)))
    count = Counter(x for f in links for x in f)
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [
        (doc, a, b, g, len(f), sum(count[x] == top[x[1]] for x in f), sum(count[x] for x in f), hashlib.sha256(s.encode()).hexdigest() if s else "", s)
        for (doc, _), (a, b, g, s), f in zip(rows, told, links, strict=True)
    ]


def _key(row):
    return tuple(-1 if v is None else v for v in row)


def test_against_whole_texts(spark):
    rows = [(i if i % 7 else None, x) for i, x in enumerate(TEXTS)] + [(3, "same row"), (3, "same row")]
    docs = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, n_a int").repartition(3)
    want = sorted(_plain(rows), key=_key)
    for size in (8 << 20, 200):  # one block a task, and a block for almost every text
        got = align(docs, Params(block_bytes=size))
        assert got.columns == COLUMNS
        assert sorted((tuple(r) for r in got.collect()), key=_key) == [w[:-1] for w in want]
    assert sorted((tuple(r) for r in groups(docs).collect()), key=_key) == sorted(((w[0], w[-1]) for w in want), key=_key)


def test_table_against_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in align(docs, Params(block_bytes=100_000)).collect()) == sorted(w[:-1] for w in _plain(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align(docs).collect() == [] and groups(docs).collect() == []


def test_cuts_hold_for_all_characters():
    """Whole texts and cut ones have the same tokens whatever character stands at a cut; U+2581 texts have none."""
    import re

    from larkspur.llm.alignment import CUT, Tokenizers

    params = Params()
    enc_a, _, enc_b, _ = _tables(params)
    t = Tokenizers(open(params.byte_level, "rb").read(), open(params.pieces, "rb").read())
    step = 37  # every 37th code point, and all up to U+3100
    for c in [*range(0x3100), *range(0x3100, 0x110000, step)]:
        if 0xD800 <= c < 0xE000 or c == 0x2581:
            continue
        text = f"a{chr(c)} b{chr(c)}{chr(c)}  c {chr(c)} d"
        cut = CUT.split(" " + text)
        assert sum(t.a(cut), []) == enc_a(text) and sum(t.b(cut), []) == enc_b(text), hex(c)
    assert re.search(r"\S", "▁")
