"""Chat formatting with typed content parts, in DataFrame functions alone.

A visitor flattens the ordered parts of each message (text, image, audio, document) into text with numbered placeholders,
recording attachment references and how many tokens each placeholder stands for. Messages then go into one template:

    <|turn|>role<|body|>text<|end|>

Control strings inside roles and texts get a backslash after their first character, and one more where some are there, so
the text reads back exactly. Neighbouring text parts are joined before that, so that no control string can be spelled over
two of them, and a placeholder names its type in letters, digits, _ and - alone (others become _). The loss mask covers
assistant texts, in code points of the formatted string.

Defined results: a null text or part is empty; a null role is empty; rows of a conversation are in order of turn (null
first), then role and text, so ties are stable; repeated rows are turns of their own; a null conversation id is a
conversation; very long texts are formatted whole; an empty table formats nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: What a tokenizer might take for control strings: the template's own, and those of other common templates.
_GUARD = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_GUARDED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens that attachments stand for: an image's tiles of 448 pixels, a second of audio, a page of a document.
TILE, TILE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 448, 256, 25, 512


def guard(text: Column) -> Column:
    return F.regexp_replace(text, _GUARD, r"$1\\$2$3")


def unguard(text: Column) -> Column:
    return F.regexp_replace(text, _GUARDED, "$1$2$3")


def _tokens(part: Column) -> Column:
    tiles = F.ceil(F.coalesce(part["width"], F.lit(TILE)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(TILE)) / TILE)
    return (
        F.when(part["type"] == "image", F.greatest(tiles, F.lit(1)) * TILE_TOKENS)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def visit(parts: Column) -> tuple[Column, Column]:
    """(pieces, attachments) of an array of parts.

    pieces: in order, {text, type, ref, tokens}: a text part's text as it is, or an attachment without text. Text parts of
    null text are empty; parts of any other type are attachments of 0 tokens, so nothing is lost.
    """
    known = F.coalesce(parts, F.array().cast(PARTS))
    pieces = F.transform(
        known,
        lambda p: F.struct(
            F.when(F.coalesce(p["type"], F.lit("text")) == "text", F.coalesce(p["text"], F.lit(""))).alias("text"),
            F.coalesce(p["type"], F.lit("text")).alias("type"),
            p["ref"].alias("ref"),
            _tokens(p).alias("tokens"),
        ),
    )
    return pieces, F.filter(pieces, lambda p: p["text"].isNull())


def flatten_parts(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, parts) -> conv_id, turn, role, body (guarded text with placeholders), attachments, tokens.

    A placeholder is <|type:number|>, numbered from 0 within the message; attachments hold number, type, ref and tokens.
    """
    pieces, attached = visit(F.col("parts"))
    rows = messages.select("conv_id", "turn", "role", pieces.alias("pieces"), attached.alias("attached"))
    start = F.struct(F.lit("").alias("body"), F.lit("").alias("run"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        """Texts wait in run until an attachment, or the end, closes it: guarding sees them as one."""
        mark = F.concat(F.lit("<|"), F.regexp_replace(p["type"], "[^0-9A-Za-z_-]", "_"), F.lit(":"), acc["n"].cast("string"), F.lit("|>"))
        said = F.struct(acc["body"].alias("body"), F.concat(acc["run"], p["text"]).alias("run"), acc["n"].alias("n"))
        return F.when(p["text"].isNotNull(), said).otherwise(F.struct(F.concat(acc["body"], guard(acc["run"]), mark).alias("body"), F.lit("").alias("run"), (acc["n"] + 1).alias("n")))

    body = F.aggregate("pieces", start, step, lambda acc: F.concat(acc["body"], guard(acc["run"])))
    refs = F.transform("attached", lambda p, i: F.struct(i.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    return rows.select("conv_id", "turn", "role", body.alias("body"), refs.alias("attachments"), F.aggregate("attached", F.lit(0).cast("long"), lambda t, p: t + p["tokens"]).alias("tokens"))


def text_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), *[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chats(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, parts) -> conv_id, formatted, loss_spans (start, end), attachments, tokens."""
    flat = flatten_parts(messages).withColumn("role", guard(F.coalesce("role", F.lit(""))))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "body", "attachments", "tokens")))
    chats = flat.groupBy("conv_id").agg(turns.alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(BODY)))
    chats = chats.withColumn("pieces", F.transform(F.arrays_zip(head.alias("head"), "turns"), lambda z: F.struct(z["head"].alias("head"), z["turns"]["body"].alias("body"), (z["turns"]["role"] == "assistant").alias("loss"))))
    # running code-point places: lengths first, then sums of all before, in one fold
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    walk = F.aggregate(
        "pieces",
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    text = F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))))
    return chats.select("conv_id", text.alias("formatted"), walk["spans"].alias("loss_spans"), F.flatten("turns.attachments").alias("attachments"), F.aggregate("turns.tokens", F.lit(0).cast("long"), lambda a, t: a + t).alias("tokens"))


def parse_chat(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted string without attachments."""
    body = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t: t != "")
    pair = F.transform(body, lambda t: F.split(t, r"<\|body\|>", 2))
    return F.transform(pair, lambda p: F.struct(unguard(p[0]).alias("role"), unguard(F.regexp_replace(p[1], r"<\|end\|>\z", "")).alias("text")))


def digests(chats: DataFrame) -> DataFrame:
    """format_chats' rows with digests of what reads back from them."""
    masked = F.transform("loss_spans", lambda s: unguard(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    back = chats.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"), F.concat_ws("", masked).alias("loss"))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all conversations, and conversation -7 whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM VALUES (-7, 0, 'user', '{trap}'), (-7, 1, 'assistant', '{trap}') AS t(conv_id, turn, role, text)")
    return digests(format_chats(text_messages(rows.unionByName(planted))))


_G = r"'([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'"
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(role, {_G})) + length(regexp_replace(text, {_G})) + 23) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
