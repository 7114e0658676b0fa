r"""Chat formatting with typed content parts.

A visitor walks the parts of a turn in order: text is escaped, each image, audio
or document part becomes a placeholder ``<kind:k>`` (k counts the attachments of
the turn), its reference is recorded, and the placeholder's expanded token count
is worked out from the part's measures.  A turn is written as

    <turn:ROLE>BODY</turn>\n

Every control string starts with ``<``.  Inside texts ``\`` becomes ``\b`` and
``<`` becomes ``\l``, so no control string can arise from a text, and replacing
``\l`` and then ``\b`` gives the text back; roles also escape ``>`` as ``\g``.
Everything is built-in expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN_END = "</turn>\n"
PARTS = "array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"
#: Expanded tokens: one per patch of 14 by 14 pixels, 25 a second of audio, 500 a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 500


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for; a missing measure counts as zero."""
    zero = F.lit(0).cast("bigint")
    n = lambda c: F.greatest(F.coalesce(part[c], zero), zero)
    return (
        F.when(part["kind"] == "image", F.ceil(n("width") / PATCH) * F.ceil(n("height") / PATCH))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", n("pages") * PAGE_TOKENS)
        .otherwise(zero)
        .cast("bigint")
    )


def text_parts(text: Column) -> Column:
    """A plain text as an array of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "bigint"), ("height", "bigint"), ("seconds", "double"), ("pages", "bigint"))))
    return F.array(part)


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The turn's body and its attachments (``k, kind, ref, tokens``), in order.

    Null parts, and null texts of text parts, are empty; an unknown kind is kept
    as an attachment of that kind without tokens.
    """
    given = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    attached = F.filter(given, lambda p: F.coalesce(p["kind"], F.lit("text")) != "text")
    numbered = F.transform(attached, lambda p, i: F.struct((i + 1).cast("bigint").alias("k"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    before = lambda i: F.size(F.filter(F.slice(given, F.lit(1), i), lambda q: ~is_text(q))) + 1
    body = F.transform(given, lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), escape_role(p["kind"]), F.lit(":"), before(i).cast("string"), F.lit(">"))))
    return F.array_join(body, ""), numbered


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None, text: str = "text") -> DataFrame:
    """One row per turn: ``conv, turn, role, segment, loss_at, loss_len, attachments``.

    ``segment`` is the turn as written; the loss mask covers ``loss_len`` code
    points from ``loss_at`` (counted from 0 in the segment), the whole body of an
    assistant's turn and nothing else.  A null role is written as an empty role.
    A map over rows: no shuffle.
    """
    name = F.coalesce(F.col(role), F.lit(""))
    if parts is None:
        body, attachments = escape(F.coalesce(F.col(text), F.lit(""))), F.array().cast("array<struct<k:bigint,kind:string,ref:string,tokens:bigint>>")
    else:
        body, attachments = flatten_parts(parts)
    head = F.concat(F.lit("<turn:"), escape_role(name), F.lit(">"))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), name.alias("role"), head.alias("head"), body.alias("body"), attachments.alias("attachments"))
    return rows.select("conv", "turn", "role", F.concat("head", "body", F.lit(TURN_END)).alias("segment"), F.length("head").alias("loss_at"), F.when(F.col("role") == "assistant", F.length("body")).otherwise(0).alias("loss_len"), "attachments")


def format_conversations(turns: DataFrame, **columns) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``mask`` (one struct
    ``at, len`` per turn, relative to the turn's segment), ``attachments`` (with
    the turn's place) and ``n_tokens_attached``.

    Turns are ordered by turn (null first), then by role and text, so ties and
    repeated rows have one defined order and all stay.  A null conversation id is
    a conversation of its own.  The formatted conversation is one value by
    contract, so its turns meet in one row; turns themselves are formatted before.
    """
    rows = format_turns(turns, **columns)
    item = F.struct("turn", "role", "segment", "loss_at", "loss_len", "attachments")
    got = rows.groupBy("conv").agg(F.sort_array(F.collect_list(item)).alias("t"))
    flat = F.flatten(F.transform("t", lambda x, i: F.transform(x["attachments"], lambda a: F.struct(i.cast("bigint").alias("turn_at"), a["k"].alias("k"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return got.select(
        "conv",
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["loss_at"].alias("at"), x["loss_len"].alias("len"))).alias("mask"),
        flat.alias("attachments"),
        F.aggregate(F.flatten(F.transform("t", lambda x: x["attachments"])), F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("n_tokens_attached"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` and ``mask`` again: ``conv, turns`` (array of ``role,
    text``) and ``loss`` (array of the masked texts, unescaped)."""
    cut = F.split(F.col("formatted"), "</turn>\n", -1)
    segments = F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))
    rest = formatted.withColumn("segments", segments)
    role = lambda s: unescape_role(F.substring_index(F.substr(s, F.lit(7)), ">", 1))
    body = lambda s: unescape(F.substr(s, F.length(F.substring_index(s, ">", 1)) + 2))
    return rest.select(
        "conv",
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.transform("segments", lambda s: F.struct(role(s).alias("role"), body(s).alias("text"))).alias("turns"),
        F.transform(F.filter(F.zip_with("segments", "mask", lambda s, m: F.struct(s.alias("s"), m["at"].alias("at"), m["len"].alias("len"))), lambda x: x["len"] > 0), lambda x: unescape(F.substr(x["s"], x["at"] + 1, x["len"]))).alias("loss"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = given.unionByName(extra)
    read = read_back(format_conversations(turns, conv="conv_id", parts=text_parts(F.col("text"))))
    loss = F.array_join("loss", "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS body,
         replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS name FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(name) + length(body) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
