"""Chat formatting with typed content parts, in DataFrame operations only.

A turn's content is an array of parts: struct(type, text, ref, units). A visitor
flattens them in order: a text part gives its text, with control strings escaped;
an image, audio or document part gives a numbered placeholder, and is recorded as
an attachment with its reference, its placeholder's number and the tokens that it
expands to (EXPANSION for each unit: an image's tiles, a second of audio, a page of
a document).

The template writes ``<turn>role`` and a line feed, the content, ``</turn>`` and a
line feed. In texts and roles every ``\\\\`` becomes ``\\\\s`` and every ``<`` becomes
``\\\\l`` (in roles, a line feed becomes ``\\\\n``), so no text holds a control string, and
replacing back is exact: after a backslash only the letters just named can follow.

The loss mask is the spans, in code points, of the assistant's contents.

Rows of a conversation are put in order by turn, then role, then escaped text; repeated
rows stay. Null text is empty, null role is the empty role, a part of unknown type
counts as a document, null content has no parts. Rows of a null conv_id are one
conversation. A conversation is one row of the result, so its turns are collected;
where they begin is summed up before, by a window over the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<turn>", "</turn>\n"
#: Tokens that a unit of an attachment expands to.
EXPANSION = {"image": 256, "audio": 25, "document": 400}


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    nothing = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), nothing.alias("ref"), F.lit(0).cast("long").alias("units")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments and n_tokens_expanded of each conversation.

    ``turns`` has conv_id, turn, role and content (an array of parts). loss_spans are
    [start, end) in code points of formatted; an attachment has turn, number (from 0
    in its turn), type, ref and tokens.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.expr("array()").cast(turns.schema["content"].dataType)).alias("content"))
    rows = rows.withColumn("content", F.filter("content", lambda p: p.isNotNull()))
    is_text = lambda p: F.coalesce(p["type"], F.lit("")) == "text"
    name = lambda p: F.when(F.coalesce(p["type"], F.lit("")).isin(*EXPANSION), p["type"]).otherwise("document")
    media = F.filter("content", lambda p: ~is_text(p))
    tokens = lambda p: F.coalesce(p["units"], F.lit(0)) * F.create_map(*[x for k, v in EXPANSION.items() for x in (F.lit(k), F.lit(v))])[name(p)]
    rows = rows.withColumn("media", F.transform(media, lambda p, i: F.struct(F.col("turn"), i.alias("number"), name(p).alias("type"), p["ref"].alias("ref"), tokens(p).cast("long").alias("tokens"))))
    # How many attachments precede a part: parts are few, so counting back is short.
    number = lambda i: F.size(F.filter(F.slice("content", 1, i), lambda q: ~is_text(q)))
    shown = F.transform("content", lambda p, i: F.when(is_text(p), escape(p["text"])).otherwise(F.concat(F.lit("<"), name(p), F.lit(":"), F.when(i > 0, number(i)).otherwise(0), F.lit(">"))))
    rows = rows.withColumn("body", F.array_join(shown, ""))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("written", F.concat("head", "body", F.lit(END)))
    rows = rows.select("conv_id", "turn", "role", "media", "written", F.length("written").alias("size"), F.length("head").alias("lead"), F.length("body").alias("held"))

    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "written")
    rows = rows.withColumn("k", F.row_number().over(in_order))
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("before") + F.col("lead")
    rows = rows.withColumn("span", F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.col("held")).alias("end"))))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "written", "span", "media"))).alias("rows"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["written"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: r["media"])).alias("attachments"),
    ).withColumn("n_tokens_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, and read back from it: turns (role and text, placeholders as written) and loss_text."""
    pieces = F.split("formatted", END.replace("\n", "\\n"), -1)

    def turn(x: Column) -> Column:
        body = F.substring(x, len(TURN) + 1, 2147483647)
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body.substr(F.length(role) + 2, F.lit(2147483647))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return chats.select("conv_id", "formatted", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))
