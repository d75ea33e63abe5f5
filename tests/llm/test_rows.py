"""Stages decide by row: null and repeated ids are rows like others."""

import random
from collections import Counter

from larkspur.llm.exact_dedup import drop_exact_duplicates
from larkspur.llm.mixing import emit, mix
from larkspur.llm.simhash import drop_near_duplicates

ROWS = [(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (None, "alone"), (7, "x y"), (7, "only of seven"), (8, "x y"), (None, "null twice"), (None, "null twice"), (9, "twin"), (9, "twin"), (5, None), (6, "")]


def test_exact_and_near_stages_keep_one_row_of_each_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = [(str(r.doc_id), r.text or "") for r in drop_exact_duplicates(docs).collect()]
    assert sorted(got) == sorted([("4", "a b c d e"), ("None", "alone"), ("7", "only of seven"), ("8", "x y"), ("None", "null twice"), ("9", "twin"), ("6", "")])
    got = [(str(r.doc_id), r.text or "") for r in drop_near_duplicates(docs).collect()]
    assert sorted(got) == sorted([("4", "a b c d e"), ("None", "alone"), ("7", "only of seven"), ("7", "x y"), ("None", "null twice"), ("9", "twin"), ("5", "")])


def test_emitted_words_meet_the_mix_with_null_and_repeated_ids(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, i]), " ".join(["w"] * rng.randint(1, 20)), rng.choice(["a", "b", "c"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in emit(docs).collect():
        taken[r.source] += len(r.text.split(" "))
    target = {r.source: r.target for r in mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - t) <= 40 for s, t in target.items())
