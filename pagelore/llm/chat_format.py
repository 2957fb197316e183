"""Chat formatting with typed content parts, as DataFrame functions alone.

A visitor flattens a turn's text, image, audio and document parts into one body: texts stay, attachments become
numbered placeholders that stand in order, with a reference and the number of tokens they expand to. Turns are marked
by control strings; the same strings inside texts are escaped and can be restored. A conversation comes out as
segments, of which those of the assistant's own text bear the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Kinds of attachments that a placeholder names.
KINDS = ("image", "audio", "document")

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # text, image, audio or document
        T.StructField("text", T.StringType()),  # of a text part
        T.StructField("ref", T.StringType()),  # where an attachment lies
        T.StructField("width", T.IntegerType()),  # pixels of an image
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),  # of audio
        T.StructField("pages", T.IntegerType()),  # of a document
    ]
)
#: Pixels of an image patch's side, tokens for a second of audio and for a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 256


def escaped(text: Column) -> Column:
    """Doubles backslashes and parts "<|" by one, so that no control string is left; see unescaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    """Roles stand on a line of their own, so "%", line ends and "<" become percent codes."""
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescaped_role(role: Column) -> Column:
    for plain, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for; unknown sizes count as 0, unknown kinds as 0."""
    patches = lambda pixels: F.ceil(F.coalesce(pixels, F.lit(0)) / F.lit(PATCH))
    return (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visited(parts: Column) -> tuple[Column, Column]:
    """(body, attachments) of an array of parts. A placeholder is numbered by the part's place in its turn.

    Null arrays and null parts hold nothing, a null text is empty. A part of another kind is an attachment of 0 tokens,
    whose placeholder says "other". Texts that follow one another are escaped as one, so that no control string comes
    about where they meet.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(T.ArrayType(PART))), lambda p: p.isNotNull())
    kind = lambda p: F.coalesce(p["kind"], F.lit("text"))
    shown = lambda p: F.when(kind(p).isin(*KINDS), kind(p)).otherwise("other")
    place = lambda p, i: F.concat(F.lit("<|"), shown(p), F.lit(":"), i.cast("string"), F.lit("|>"))
    told = F.transform(parts, lambda p, i: F.struct((kind(p) == "text").alias("plain"), F.when(kind(p) == "text", F.coalesce(p["text"], F.lit(""))).otherwise(place(p, i)).alias("said")))
    step = lambda acc, x: F.struct(
        F.when(x["plain"], acc["done"]).otherwise(F.concat(acc["done"], escaped(acc["run"]), x["said"])).alias("done"), F.when(x["plain"], F.concat(acc["run"], x["said"])).otherwise("").alias("run")
    )
    body = F.aggregate(told, F.struct(F.lit("").alias("done"), F.lit("").alias("run")), step, lambda acc: F.concat(acc["done"], escaped(acc["run"])))
    found = F.transform(parts, lambda p, i: F.struct(i.alias("part"), kind(p).alias("kind"), p["ref"].alias("ref"), place(p, i).alias("placeholder"), expanded_tokens(p).alias("n_tokens")))
    return body, F.filter(found, lambda a: a["kind"] != "text")


def with_text_parts(turns: DataFrame, text: str = "text") -> DataFrame:
    """turns with a column parts, made of the one text that each has."""
    empty = {f.name: F.lit(None).cast(f.dataType) for f in PART.fields}
    fields = empty | {"kind": F.lit("text"), "text": F.coalesce(F.col(text).cast("string"), F.lit(""))}
    return turns.withColumn("parts", F.array(F.struct(*(v.alias(k) for k, v in fields.items()))))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """A row per conversation: conv_id, formatted, segments array<struct<text, loss>>, attachments and n_tokens.

    turns has a row per turn. Turns stand in order of turn, nulls first, then role and body, so that ties and repeated
    rows have one order; each stays a turn of its own. A null role is empty. formatted is the segments' texts put
    together. attachments are structs (turn, part, kind, ref, placeholder, n_tokens), n_tokens (long) their sum. A
    conversation with a null id is one conversation.
    """
    body, attachments = visited(F.col(parts))
    role_text = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("_turn"), role_text.alias("_role"), body.alias("_body"), attachments.alias("_attachments"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_turn", "_role", "_body", "_attachments"))).alias("_turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(
                piece(F.concat(F.lit(START), escaped_role(t["_role"]), F.lit("\n")), F.lit(False)),
                piece(t["_body"], t["_role"] == ASSISTANT),
                piece(F.lit(f"{END}\n"), F.lit(False)),
            ),
        )
    )
    flat = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.transform(t["_attachments"], lambda a: F.struct(t["_turn"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["placeholder"].alias("placeholder"), a["n_tokens"].alias("n_tokens"))),
        )
    )
    made = one.select("conv_id", segments.alias("segments"), flat.alias("attachments"))
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"])
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments", total.alias("n_tokens"))


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation; text is unescaped."""
    marked = F.slice(F.split(formatted, "<\\|im_start\\|>"), 2, 1 << 30)
    return F.transform(
        marked,
        lambda x: F.struct(
            unescaped_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescaped(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - (1 + len(END) + 1))).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped: nothing stands between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
