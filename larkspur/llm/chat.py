"""Chat formatting of typed content parts. DataFrame functions only.

Template: ``<|turn|>`` role ``<|body|>`` content ``<|end|>`` for each turn. Roles and texts are escaped: a control string
that occurs in them gets one more backslash after its first character, however many it has there, so none of them is
left as it was and taking one away again gives the text back. Parts that are no text become placeholders; what they stood
for is kept beside the formatted text, in the same order, and goes back in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"

#: The control strings of common chat templates, as a pattern that allows backslashes after the first character.
_TOKENS = r"(\||｜|/?(?:s|bos|eos|pad|unk|mask|SYS|system|user|assistant|human|bot|tool|(?:start|end)_of_turn)>|/?[A-Z_]+\])"
CONTROL = r"([<\[])(\\*)" + _TOKENS
ESCAPED = r"([<\[])\\(\\*)" + _TOKENS

#: Placeholder of each part kind, and the tokens it expands to: a fixed count, or one for each of so many units.
PARTS = {"image": ("<|image|>", 576, None), "audio": ("<|audio|>", 0, 25.0), "document": ("<|document|>", 0, 400.0)}
_MARKS = r"<\|(?:image|audio|document)\|>"

#: A reference inside a text: kind, units (seconds of audio, pages of a document) and the address.
REFERENCE = r"!\[(image|audio|document)(?: ([0-9]+(?:\.[0-9]+)?))?\]\(([^()\x20\x09-\x0D]*)\)"

PART_TYPE = "array<struct<kind:string,text:string,ref:string,units:double>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def _placeholder(part: Column) -> Column:
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, (mark, _, _) in PARTS.items():
        out = F.when(part["kind"] == kind, F.lit(mark)).otherwise(out)
    return out


def _tokens(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind, (_, fixed, each) in PARTS.items():
        n = F.lit(fixed) if each is None else F.ceil(F.greatest(F.coalesce(part["units"], F.lit(0.0)), F.lit(0.0)) * F.lit(each))
        out = F.when(part["kind"] == kind, n.cast("long")).otherwise(out)
    return out


def _part(kind: Column, text: Column, ref: Column, units: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), ref.alias("ref"), units.cast("double").alias("units"))


def text_part(c: Column) -> Column:
    none = F.lit(None)
    return F.array(_part(F.lit("text"), c, none.cast("string"), none))


def typed_parts(c: Column) -> Column:
    """The parts of a text that refers to images, audio and documents: ``![image](address)``, ``![audio 12.5](address)``.

    What stands between references is text. Parts that are no text keep what they stood as, so nothing is lost. Null is empty.
    """
    text, none = F.coalesce(c, F.lit("")), F.lit(None)
    groups = [F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(i)).alias(f"g{i}") for i in range(4)]
    zipped = F.arrays_zip(F.split(text, REFERENCE, -1).alias("t"), *groups)
    pair = lambda z: F.array(_part(F.lit("text"), z["t"], none.cast("string"), none), _part(z["g1"], z["g0"], z["g3"], F.nullif(z["g2"], F.lit(""))))
    parts = F.filter(F.flatten(F.transform(zipped, pair)), lambda p: p["text"] != "")
    return F.when(F.regexp_like(text, F.lit(REFERENCE)), parts).otherwise(text_part(text))


def format_chats(turns: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts).

    Visiting the parts in order, text is escaped and other kinds become placeholders, whose references are kept in
    ``attachments`` (turn index, part index, kind, text, ref, tokens). ``loss`` has [start, end) of the contents of
    loss_roles in code points of ``formatted``, with the index of their turn. ``expanded_tokens`` counts what the placeholders stand for.

    Null role and null text are empty, a null or unknown kind is text, null or no parts make empty content, null conv_id is a
    conversation of its own. Turns with equal numbers stand in the order of role, then content; null numbers come first; turns
    that are alike each stand. Other columns are left out. A conversation is one training example and one row: its own
    turns meet in a task, nothing else does, and all steps are linear in them.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PART_TYPE))
    content = F.array_join(F.transform(parts, _placeholder), "")
    media = F.filter(
        F.transform(parts, lambda p, i: F.struct(i.cast("int").alias("part"), p["kind"].alias("kind"), p["text"].alias("text"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))),
        lambda x: F.coalesce(x["kind"].isin(*PARTS), F.lit(False)),
    )
    flat = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), media.alias("media")).alias("t"))
    head = F.concat(F.lit(TURN), escape(F.col("t.role")), F.lit(BODY))
    order = Window.partitionBy("conv_id").orderBy("t")
    sized = flat.withColumn("head", head).withColumn("size", F.length("head") + F.length("t.content") + F.lit(len(END)))
    placed = sized.withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("i", F.row_number().over(order) - 1)
    start = F.col("at") + F.length("head")
    rows = placed.select(
        "conv_id",
        F.struct(
            "i", F.concat("head", "t.content", F.lit(END)).alias("text"), "t.media", F.col("t.role").isin(*loss_roles).alias("on"),
            F.struct("i", start.alias("start"), (start + F.length("t.content")).alias("end")).alias("span"),
        ).alias("r"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    attached = lambda r: F.transform(r["media"], lambda m: F.struct(r["i"].alias("turn"), m["part"].alias("part"), m["kind"].alias("kind"), m["text"].alias("text"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("rs", lambda r: r["text"]), "").alias("formatted"),
        F.transform(F.filter("rs", lambda r: r["on"]), lambda r: r["span"]).alias("loss"),
        F.flatten(F.transform("rs", attached)).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def restored(content: Column, attachments: Column, turn: Column) -> Column:
    """The text of a turn's content: unescaped, with what each placeholder stood for (nothing, if that was no text) in its place."""
    own = F.transform(F.filter(attachments, lambda a: a["turn"] == turn), lambda a: F.coalesce(a["text"], F.lit("")))
    pieces = F.zip_with(F.split(content, _MARKS, -1), own, lambda t, a: F.concat(unescape(F.coalesce(t, F.lit(""))), F.coalesce(a, F.lit(""))))
    return F.when(F.exists(attachments, lambda a: a["turn"] == turn), F.array_join(pieces, "")).otherwise(unescape(content))


def read_turns(formatted: Column, attachments: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    bodies = F.filter(F.split(formatted, r"\Q" + TURN + r"\E", -1), lambda x: x != "")
    content = lambda b: F.substring(b, F.instr(b, BODY) + len(BODY), F.length(b) - F.instr(b, BODY) - len(BODY) + 1 - len(END))
    return F.transform(bodies, lambda b, i: F.struct(unescape(F.substring_index(b, BODY, 1)).alias("role"), restored(content(b), attachments, i).alias("text")))


def loss_text(formatted: Column, loss: Column, attachments: Column) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(loss, lambda s: restored(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), attachments, s["i"])), "")


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(turns.select("conv_id", "turn", "role", typed_parts(F.col("text")).alias("parts")))
    formatted, attachments = F.col("formatted"), F.col("attachments")
    read = chats.withColumn("turns", read_turns(formatted, attachments))
    masked = loss_text(formatted, F.col("loss"), attachments)
    return read.withColumn("masked", masked).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.sha2(F.array_join(F.transform("attachments", lambda a: F.concat_ws("\n", a["kind"], a["ref"], a["tokens"].cast("string"))), "\n"), 256).alias("attachments_sha256"),
        "expanded_tokens",
    )


def _sql() -> str:
    control, reference, marks = CONTROL, REFERENCE, {k: m for k, (m, _, _) in PARTS.items()}
    ticks = "CASE k WHEN 'image' THEN 576 WHEN 'audio' THEN CAST(ceil(u * 25) AS BIGINT) ELSE CAST(ceil(u * 400) AS BIGINT) END"
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS row, * FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, string_split_regex(text, '{reference}') AS between, regexp_extract_all(text, '{reference}', 1) AS ks FROM t),
e AS (
  SELECT *, regexp_replace(role, '{control}', '\1\\\2\3', 'g') AS erole,
         list_aggregate(list_transform(list_zip(between, ks), lambda z: regexp_replace(z[1], '{control}', '\1\\\2\3', 'g')
           || CASE coalesce(z[2], '') WHEN '' THEN '' WHEN 'image' THEN '{marks["image"]}' WHEN 'audio' THEN '{marks["audio"]}' ELSE '{marks["document"]}' END), 'string_agg', '') AS etext
  FROM p),
m AS (
  SELECT row, count(*) AS n, sum({ticks}) AS tokens, string_agg(k || chr(10) || r || chr(10) || {ticks}, chr(10) ORDER BY i) AS listed FROM (
    SELECT row, unnest(range(len(ks))) AS i, unnest(ks) AS k, unnest(regexp_extract_all(text, '{reference}', 3)) AS r,
           coalesce(TRY_CAST(unnest(regexp_extract_all(text, '{reference}', 2)) AS DOUBLE), 0) AS u FROM p) GROUP BY row),
a AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_attachments, CAST(sum(tokens) AS BIGINT) AS expanded_tokens,
             string_agg(listed, chr(10) ORDER BY turn NULLS FIRST, role, etext) AS listed FROM e JOIN m USING (row) GROUP BY conv_id),
c AS (SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, etext)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, etext) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(erole) + length(etext) + 8 + 8 + 7) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT c.*, coalesce(n_attachments, 0) AS n_attachments, sha256(coalesce(listed, '')) AS attachments_sha256, coalesce(expanded_tokens, 0) AS expanded_tokens
FROM c LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
"""


OP8_SQL = _sql()
