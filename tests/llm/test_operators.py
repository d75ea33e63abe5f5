import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, decontam, licenses, mixing, secrets, toxicity


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_base_secrets(spark):
    docs = [(1, 'x api_key = "abcdef12"\npassword: abc', "a"), (2, None, "a"), (3, "", None), (4, "AKIA" + "A1" * 9 + " " + "0a" * 14, "b"), (5, "é token=ABCDEF", "c")]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.base] for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {1: [(2, 21, "assign")], 2: [], 3: [], 4: [(0, 22, "access"), (23, 51, "hex")], 5: [(2, 14, "assign")]}
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_passages_with_substitutions_are_found(spark):
    rng = random.Random(4)
    item = _words(rng, 40)
    changed = item.split(" ")
    changed[7] = changed[20] = "other"
    docs = [(1, _words(rng, 300)), (2, _words(rng, 50) + " " + item + " " + _words(rng, 50)), (3, " ".join(changed)), (4, None), (5, "")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item), (10, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_start, r.overlap, r.mismatches) for r in decontam.contamination(docs, bench).collect()}
    assert got == {(2, 9): (50, 40, 0), (3, 9): (0, 40, 2)}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()) == [1, 4, 5]
    assert decontam.contamination(docs, bench.limit(0)).collect() == []


@pytest.mark.parametrize("text,template,paired", [("a b c d", "a b c d", 4), ("a x c d", "a b c d", 3), ("x y", "a b", 0), ("b a", "a b", 1)])
def test_patience_alignment(text, template, paired):
    number = {w: i for i, w in enumerate(sorted({*text.split(), *template.split()}))}
    assert licenses.align([number[w] for w in text.split()], [number[w] for w in template.split()]) == paired


def test_licenses(spark):
    docs = [(1, "Notes.\n" + licenses.TEMPLATES["MIT"] + "\nend"), (2, "nothing here"), (3, None)]
    got = [(r.doc_id, r.license, r.coverage) for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert (1, "MIT", 1.0) in got and {d for d, *_ in got} == {1}


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, _words(rng, rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert len(got) == 3 and all(abs(r.taken - r.target) <= 60 and r.over <= 0 for r in got)


def test_chat_round_trip(spark):
    said = "<|end|> </s>[INST] a\\b <\\|turn|>"
    turns = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    got = {r.conv_id: [tuple(t) for t in r.t] for r in out.select("conv_id", chat.read_turns(F.col("formatted"), F.col("attachments")).alias("t")).collect()}
    assert got == {1: [("user", said), ("assistant", said)], 2: [("", "")]}


def test_toxicity_without_labels_and_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r["__ls_score"] <= 1 for r in toxicity.scored(docs, labels).collect())


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    s = toxicity.scored(docs, labels).join(labels.where(toxicity.HELD_OUT), "doc_id").select("__ls_score", "toxic").collect()
    good, bad = [r[0] for r in s if r.toxic == 0], [r[0] for r in s if r.toxic == 1]
    assert good and bad and sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad)) > 0.8
