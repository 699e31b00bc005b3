"""Chat formatting with typed content parts, in DataFrame functions alone.

A message holds an array of parts (kind, text, ref, tokens). A visitor walks the parts in order: a text part gives its
escaped text; an image, audio or document part gives a numbered placeholder, and its reference and token count go to the
attachment list. A turn is <|im_start|> role <|im_sep|> content <|im_end|>. The loss mask is a list of (start, length) spans in code points of
the output, one for each assistant text.

Escaping: a backslash becomes two, and the first character of a control string is parted from the rest by a backslash, so
no control string of the template or of common chat formats can stand in a text; a backslash before any character
is dropped again on reading. Texts, roles and references are escaped alike, so reading back is exact for any input.

Null text or role counts as empty, null parts as none; turns stand in order of turn (null first), then role, then content; rows
repeated in a conversation are kept; a null conversation id is a conversation. A conversation is one output row, so its turns meet in one
task; that is bounded by the conversation's own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Kinds of attachments, and the tokens that one stands for when its part doesn't say.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"
#: A control string begins with one of these: <| or <s> </s> [INST] [/INST].
CONTROL = "(<)(?=\\||/?s>)|(\\[)(?=/?INST\\])"


def escape(col: Column) -> Column:
    return F.regexp_replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1$2\\\\")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, "\\\\([\\s\\S])", "$1")


def text_parts(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Plain rows as rows with one text part each, in the column parts."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
    return messages.withColumn("parts", F.array(part))


def _size(part: Column) -> Column:
    given = F.when(part["kind"] == "image", EXPANDED["image"]).when(part["kind"] == "audio", EXPANDED["audio"]).when(part["kind"] == "document", EXPANDED["document"]).otherwise(0)
    return F.coalesce(part["tokens"], given).cast("long")


def _content(parts: Column) -> Column:
    """The parts as one string; other parts than texts become <|kind:n|>, n counting from 0 in the message."""
    others = F.filter(parts, lambda p: p["kind"] != "text")
    place = lambda i: F.concat(F.lit("<|"), escape(parts[i]["kind"]), F.lit(":"), F.size(F.filter(F.slice(parts, 1, i + 1), lambda q: q["kind"] != "text")) - 1, F.lit("|>"))
    only_text = F.array_join(F.transform(parts, lambda p: escape(F.coalesce(p["text"], F.lit("")))), "")
    mixed = F.array_join(F.transform(parts, lambda p, i: F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(place(i))), "")
    return F.when(F.size(others) == 0, only_text).otherwise(mixed)


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv, n_turns, formatted, loss_spans, attachments, attachment_tokens) for each conversation.

    messages has the parts column, see text_parts. attachments: (turn index, number in the message, kind, ref, tokens).
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    parts = F.transform(parts.cast(f"array<{PART}>"), lambda p: F.struct(F.coalesce(p["kind"], F.lit("text")).alias("kind"), p["text"].alias("text"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    m = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    files = F.transform(F.filter("parts", lambda p: p["kind"] != "text"), lambda p, i: F.struct(i.alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), _size(p).alias("tokens")))
    m = m.select("conv", F.struct("turn", "role", _content(F.col("parts")).alias("content"), files.alias("files")).alias("t"))
    c = m.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))
    c = c.withColumn("piece", F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["content"].alias("content"), (t["role"] == "assistant").alias("learn"))))
    c = c.withColumn("formatted", F.array_join(F.transform("piece", lambda p: F.concat(p["head"], p["content"], F.lit(END))), ""))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    step = lambda a, p: F.struct(
        (a["at"] + F.char_length(p["head"]) + F.char_length(p["content"]) + len(END)).cast("long").alias("at"),
        F.when(p["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.char_length(p["head"])).cast("long").alias("start"), F.char_length(p["content"]).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    c = c.withColumn("loss_spans", F.aggregate("piece", first, step, lambda a: a["spans"]))
    attachments = F.flatten(F.transform("turns", lambda t, i: F.transform(t["files"], lambda f: F.struct(i.alias("turn_index"), f["number"].alias("number"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    c = c.withColumn("attachments", attachments).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    return c.select(F.col("conv").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), "formatted", "loss_spans", "attachments", "attachment_tokens")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from the output; placeholders stay in the text as written."""
    blocks = F.split(formatted, "\\Q" + END + "\\E")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    side = lambda b, i: unescape(F.element_at(F.split(F.substring(b, len(START) + 1, 2147483647), "\\Q" + SEP + "\\E", 2), i))
    return F.transform(blocks, lambda b: F.struct(side(b, 1).alias("role"), side(b, 2).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"].cast("int") + 1, s["length"].cast("int")))), "")
