"""Chat formatting with typed content parts, in column arithmetic.

A turn is a list of parts. A visitor turns each part into text: a text part is escaped, an image,
audio or document part becomes a placeholder, and its reference and the tokens it will expand to
are recorded. The template writes a conversation as ``<s>`` turns ``</s>``, a turn as ``[TAG]`` text
``[/TAG]``. Escaping leaves no ``[`` and no ``<`` in a text, so no control string can occur in one:
a backslash becomes ``\\0``, ``[`` becomes ``\\1`` and ``<`` becomes ``\\2``. Every backslash of the
output starts an escape, which makes it reversible.

A conversation is one training example and one row; other conversations never meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values of the template: tags of the common roles; other roles are written out.
TAGS = {"user": "INST", "system": "SYS", "assistant": "OUT"}
OTHER = "ROLE "
BEGIN, END = "<s>", "</s>"
LOSS_ROLE = "assistant"
PATCH = 28  # pixels of an image side that make one token
AUDIO_TOKENS = 25  # tokens for each second
CHUNK = 2048  # code points a span is read from at a time
PAGE_TOKENS = 256  # tokens for each page of a document
PARTS = ("array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")


def escape(text: Column, more: str = "") -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\0"))
    for i, c in enumerate("[<" + more, 1):
        out = F.replace(out, F.lit(c), F.lit(f"\\{i}"))
    return out


def unescape(text: Column, more: str = "") -> Column:
    for i, c in enumerate("[<" + more, 1):
        text = F.replace(text, F.lit(f"\\{i}"), F.lit(c))
    return F.replace(text, F.lit("\\0"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """One text part; a null text is an empty one."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none("string").alias("ref"),
        none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"),
        none("int").alias("pages")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; unknown sizes and types count as none."""
    cells = lambda side: F.ceil(part[side] / F.lit(PATCH))
    count = (F.when(part["type"] == "image", cells("width") * cells("height"))
             .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS))
             .when(part["type"] == "document", part["pages"] * PAGE_TOKENS))
    return F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("long")


def _tag(role: Column) -> Column:
    tag = F.concat(F.lit(OTHER), escape(role, "]"))
    for name, short in TAGS.items():
        tag = F.when(role == name, F.lit(short)).otherwise(tag)
    return tag


def _role(tag: Column) -> Column:
    role = unescape(F.substr(tag, F.lit(len(OTHER) + 1)), "]")
    for name, short in TAGS.items():
        role = F.when(tag == short, F.lit(name)).otherwise(role)
    return role


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 parts: str = "parts") -> DataFrame:
    """A row per conversation: its id under ``conv``, ``formatted``, ``loss`` and ``attachments``.

    ``parts`` has the type PARTS. ``loss`` lists (start, length), in code points of ``formatted``, of
    the assistant texts. ``attachments`` lists (turn, place, part, type, ref, n_tokens) in order, place
    being the turn's number from 0; its placeholder is ``<type:place.part>``. Turns are ordered by
    ``turn``, nulls first, equal ones by role and parts; a null role is an empty one, a null list of
    parts an empty text; rows with a null conversation id form one conversation.
    """
    order = Window.partitionBy("c").orderBy("turn", "role", "parts")
    rows = turns.select(
        F.col(conv).alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("parts")).withColumn("i", F.row_number().over(order) - 1)
    body = F.array_join(F.transform("parts", lambda p, j: F.when(_is_text(p), escape(p["text"])).otherwise(F.concat(
        F.lit("<"), escape(p["type"]), F.lit(":"), F.col("i").cast("string"), F.lit("."), j.cast("string"),
        F.lit(">")))), "")
    attached = F.filter(F.transform("parts", lambda p, j: F.struct(
        F.col("turn").alias("turn"), F.col("i").alias("place"), j.alias("part"), p["type"].alias("type"),
        p["ref"].alias("ref"), expanded_tokens(p).alias("n_tokens"))),
        lambda a: F.coalesce(a["type"], F.lit("text")) != "text")
    rows = rows.select("c", "turn", "role", "parts", "i", _tag(F.col("role")).alias("tag"), body.alias("body"),
                       attached.alias("attached"))
    # Where a turn starts is a running sum over the turns before it, in the order they already have.
    size = (2 * F.char_length("tag") + 5 + F.char_length("body")).cast("long")
    start = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.char_length("tag") + 2
    rows = rows.withColumn("start", start + len(BEGIN))
    chats = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct(
        "i", "tag", "body", "start", (F.col("role") == LOSS_ROLE).alias("learn"), "attached"))).alias("written"))
    whole = F.concat(F.lit(BEGIN), F.array_join(F.transform("written", lambda w: F.concat(
        F.lit("["), w["tag"], F.lit("]"), w["body"], F.lit("[/"), w["tag"], F.lit("]"))), ""), F.lit(END))
    loss = F.transform(F.filter("written", lambda w: w["learn"]), lambda w: F.struct(
        w["start"].cast("long").alias("start"), F.char_length(w["body"]).cast("long").alias("length")))
    return chats.select(F.col("c").alias(conv), whole.alias("formatted"), loss.alias("loss"),
                        F.flatten(F.transform("written", lambda w: w["attached"])).alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay as they are."""
    inner = F.substr(formatted, F.lit(len(BEGIN) + 1), F.char_length(formatted) - len(BEGIN) - len(END))
    opened = F.filter(F.split(inner, "\\["), lambda s: (s != "") & ~F.startswith(s, F.lit("/")))
    return F.transform(opened, lambda s: F.struct(
        _role(F.substring_index(s, "]", 1)).alias("role"),
        unescape(F.substr(s, F.locate("]", s) + 1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, without anything between its spans.

    Counting code points from the front for every span would be quadratic, so the text is cut into
    chunks once and a span is read from the chunks that it touches.
    """
    def piece(chunks: Column, s: Column) -> Column:
        first = F.floor(s["start"] / F.lit(CHUNK)).cast("int")
        last = F.floor((s["start"] + s["length"]) / F.lit(CHUNK)).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return F.substr(near, (s["start"] - first * CHUNK + 1).cast("int"), s["length"].cast("int"))

    # A list of one, so that the chunks are a value of its element and not made anew for every span.
    chunks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    both = F.array(F.struct(chunks.alias("chunks"), loss.alias("loss")))
    pieces = F.transform(both, lambda x: F.array_join(F.transform(x["loss"], lambda s: piece(x["chunks"], s)), ""))
    return unescape(F.element_at(pieces, 1))
