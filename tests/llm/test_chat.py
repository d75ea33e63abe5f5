"""Chat formatting: typed parts, control strings, ties, repeated rows, long texts, clashing columns, the SQL text."""

import random

from pyspark.sql import functions as F

from larkspur.llm import chat

SAID = ["<<SYS>> be kind <</SYS>>", "<start_of_turn>user<end_of_turn>", "<system></system>", "<\\\\|end|>[INST][\\/INST]</s><s>", "<|image|> literal", "[TOOL_CALLS] <｜bar", "![image](a.png) and ![audio 2.5](b.wav)![document 3](c.pdf)", "![image 7]() ![video](x) ![image](a b)", "", "é\U0001f600 ![image](é)"]


def test_parts_become_placeholders_and_come_back(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", None), ("audio", "![audio 2](b)", "b", 2.0), ("document", None, "c", 1.5), (None, "<|image|>", None, None), ("sheet", "odd", None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts, "x"), (1, 1, "assistant", None, "y")], f"conv_id long, turn long, role string, parts {chat.PART_TYPE}, t string")
    r = chat.format_chats(turns).select("*", chat.read_turns(F.col("formatted"), F.col("attachments")).alias("read")).first()
    assert r.formatted == "<|turn|>user<|body|>see <|image|><|audio|><|document|><\\|image|>odd<|end|><|turn|>assistant<|body|><|end|>"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 576), (0, 2, "audio", "b", 50), (0, 3, "document", "c", 600)]
    assert r.expanded_tokens == 1226 and [tuple(x) for x in r["read"]] == [("user", "see ![audio 2](b)<|image|>odd"), ("assistant", "")]
    assert [r.formatted[s.start : s.end] for s in r.loss] == [""]


def _table(spark, path):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", None, "<|turn|>"]), rng.choice([None, rng.choice(SAID) + rng.choice(SAID)])) for _ in range(120)]
    rows += [(50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (51, 0, "user", "x ![image](r) <|" * 3_000)] + [(52, i % 3, "assistant", f"{i}") for i in range(5_000)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, content string, i int")
    docs.write.parquet(f"{path}/conversations.parquet")
    return rows


def test_same_as_sql_and_brute_force(spark, tmp_path):
    import hashlib

    import duckdb

    rows = _table(spark, tmp_path)
    out = chat.op8_chat_format(spark, str(tmp_path))
    got = {r.conv_id: r.asDict() for r in out.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(chat.OP8_SQL)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(out.columns)
    assert got == {r["conv_id"]: r for r in (dict(zip(names, x, strict=True)) for x in want.fetchall())}
    for c in (50, 51, 52):
        turns = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        if c != 52:
            assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["loss_chars"] == len(said) and got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_control_strings_never_survive(spark):
    import re

    rows = [(i, 0, "assistant", s) for i, s in enumerate(SAID)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns.select("conv_id", "turn", "role", chat.typed_parts(F.col("text")).alias("parts")))
    for r in out.select("*", chat.loss_text(F.col("formatted"), F.col("loss"), F.col("attachments")).alias("said")).collect():
        assert r.said == SAID[r.conv_id]
        inside = re.sub(r"<\|(image|audio|document)\|>", "", r.formatted[len("<|turn|>assistant<|body|>") : -len("<|end|>")])
        assert not re.search(r"[<\[](\||｜|/?(s|SYS|system|start_of_turn|end_of_turn)>|/?(INST|TOOL_CALLS)\])", inside)
