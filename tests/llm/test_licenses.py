"""License places against brute force: an alignment of every window of a text."""

import random

import pyarrow as pa
from larkspur.llm import licenses
from larkspur.llm.tokens import token_runs

NAMES = ("MIT", "Apache-2.0-line", "ISC", "MPL-2.0")


def _changed(rng, words, share, pool):
    out = list(words)
    for i in rng.sample(range(len(out)), int(len(out) * share)):
        out[i] = rng.choice(pool)
    return out


def _brute(text, template, least):
    room = len(template) // 4 + 2
    width = len(template) + 2 * room
    return any(licenses.align(text[i : i + width], template) >= least * len(template) for i in range(max(1, len(text) - width + 1)))


def test_places_in_long_texts_against_brute_force(spark):
    """Prose of the templates' own words, notices that lack up to a fifth of theirs, each lacking word used elsewhere."""
    rng = random.Random(7)
    split = lambda t: ["".join(c if c.isalnum() else " " for c in w) for w in t.lower().split()]
    pool = [w for n in NAMES for w in " ".join(split(licenses.TEMPLATES[n])).split()]
    docs = []
    for i in range(60):
        name = NAMES[i % 4]
        notice = _changed(rng, " ".join(split(licenses.TEMPLATES[name])).split(), rng.choice([0, 0.05, 0.1, 0.15]), [*pool, "zzz"])
        prose = [rng.choice([*pool, "alpha", "beta", "gamma"]) for _ in range(rng.choice([30, 400, 900]))]
        at = rng.randint(0, len(prose))
        docs.append((i, " ".join(prose[:at] + (notice if i % 5 else []) + prose[at:])))
    docs += [(100, None), (101, ""), (None, licenses.TEMPLATES["MIT"]), (None, licenses.TEMPLATES["MIT"]), (102, (licenses.TEMPLATES["ISC"] + " and more ") * 300)]
    templates = {n: licenses.TEMPLATES[n] for n in NAMES}
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, license string, start int")
    rows = licenses.license_scan(table, templates).collect()
    got = {(r.doc_id, r.license) for r in rows if r.doc_id is not None and r.doc_id < 100}
    words = lambda t: next(token_runs(pa.array([t])))[1].tolist()
    want = {(i, n) for i, t in docs if i is not None and i < 100 for n in NAMES if _brute(words(t), words(templates[n]), licenses.LEAST)}
    assert len(want) > 30 and got == want
    assert [(r.license, r.coverage) for r in rows if r.doc_id is None] == [("MIT", 1.0)] * 2
    assert [(r.license, r.copies) for r in rows if r.doc_id == 102] == [("ISC", 300)]


def test_words_that_tell_templates_apart(spark):
    t = licenses.TEMPLATES
    docs = [(1, t["GPL-3.0-or-later"]), (2, t["LGPL-2.1-or-later"]), (3, t["AGPL-3.0-or-later"]), (4, "SPDX-License-Identifier: Zlib"), (5, t["CC-BY-SA-line"]), (6, "Licensed under the Apache License, Version 1.1.")]
    got = {}
    for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert "LGPL-2.1-or-later" not in got[1] | got[3] and "AGPL-3.0-or-later" not in got[1] | got[2] and "CC-BY-SA-line" in got[5]
    assert "GPL-3.0-or-later" in got[1] and "LGPL-2.1-or-later" in got[2] and "AGPL-3.0-or-later" in got[3] and 4 not in got and 6 not in got
