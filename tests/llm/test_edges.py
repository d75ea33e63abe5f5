"""Nulls, empty tables, repeated rows, very long texts and clashing columns for the operators and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import chat, decontam, licenses, lm_score, mixing, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, row long, score double, kind string, size long, part int, key string, taken string, __x string"


def _frame(spark, rows):
    """Documents with columns named like those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3.0, "k", 4, 5, "key", "t", None) for i, t, s in rows], SCHEMA)


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null and repeated ids, null and empty texts, ties, one very long text without a space and one with many."""
    return [(1, "same text here", "a"), (1, "same text here", "a"), (2, "same text here", None), (None, None, None), (None, "", "b"), (3, "x" * 300_000, "a"), (4, "ab cd " * 50_000, "b")]


def test_odd_rows_keep_a_row_each(spark, odd):
    docs, n = _frame(spark, odd), len(odd)
    bench = spark.createDataFrame([(9, "unseen words of an item that nobody has copied into any text at all"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert secrets.scan(docs).count() == n
    assert mixing.mix(docs).count() == n
    scores = lm_score.score(docs, F.lit(True)).collect()
    assert len(scores) == n and all(abs(r.score) < 1e-9 for r in scores)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in scores) == [(0, 0), (0, 0), (1, 3), (1, 3), (2, 3), (3, 1), (4, 100_000)]
    toxic = toxicity.scored(docs, labels).collect()
    assert len(toxic) == n and all(0 <= r["__ls_score"] <= 1 for r in toxic)
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns
    assert decontam.drop_contaminated(docs, bench).count() == n and decontam.contamination(docs, bench).count() == 0
    assert licenses.license_scan(docs).count() == 0


def test_empty_tables(spark):
    docs = _frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (secrets.scan(docs), mixing.mix(docs), mixing.emit(docs), lm_score.score(docs, F.lit(True)), toxicity.scored(docs, labels), decontam.contamination(docs, bench), licenses.license_scan(docs)):
        assert out.collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).collect() == []


def test_emitted_copies_match_the_mix(spark):
    rng = random.Random(8)
    docs = _frame(spark, [(i, _words(rng, rng.randint(0, 20)), rng.choice(["a", "b", None])) for i in range(120)])
    plan = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.emit(docs)
    assert out.columns == [*docs.columns, "copy_no"]
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {d: c for d, c in plan.items() if c}
    assert plan == {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}


def test_pipeline_stages_on_small_input(spark, tmp_path):
    """Copies, near copies and passages go, clean documents stay, stage by stage."""
    rng = random.Random(5)
    item = _words(rng, 30)
    clean = [(i, _words(rng, 200), "a") for i in range(8)]
    near = clean[0][1].split(" ")
    near[100] = "other"
    last = _words(rng, 60) + " " + item
    docs = spark.createDataFrame([*clean, (20, clean[1][1], "b"), (21, " ".join(near), "b"), (22, last, "b")], "doc_id long, text string, source string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "simhash near-dedup", "benchmark decontamination", "mixing"]
    after = {}
    for name in list(stages)[1:4]:
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{len(after)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(after)}")
        after[name] = sorted(r.doc_id for r in docs.collect())
    assert after["exact dedup"] == [0, 2, 3, 4, 5, 6, 7, 20, 21, 22]
    texts = {i: t for i, t, _ in [*clean, (20, clean[1][1], "b"), (21, " ".join(near), "b"), (22, last, "b")]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, texts[i].split(" ")) for i in after["exact dedup"])}
    similar = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    assert similar(sets[0], sets[21])
    assert after["simhash near-dedup"] == [i for i in sets if not any(j < i and similar(sets[i], sets[j]) for j in sets)]
    assert set(after["benchmark decontamination"]) == set(after["simhash near-dedup"]) - {22}
