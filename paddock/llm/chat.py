"""Chat formatting with Spark expressions only: collected turns are sorted, merged and concatenated.

The template puts every run of turns of one role into a block

    <|start|>role<|body|>text<|next|>text...<|end|>

so adjacent turns of one role share a block and still read back one by one. Control strings inside
roles and texts are broken up by an escape that is undone on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, NEXT, END = "<|start|>", "<|body|>", "<|next|>", "<|end|>"
#: What must never appear inside a text: our own marks and the common ones of other templates, each
#: given as first character and rest.
_CONTROL = r"([<\[])(\||/?s>|/?INST\]|<SYS>|</SYS>|</?SYS>)"
_ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    r"""Double every backslash, then put ``\.`` after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\.$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)|\\\.", "$1")


def format_conversations(turns: DataFrame, loss_role: str = _ASSISTANT) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length in code points), n_blocks.

    ``turns`` has conv_id, turn, role, text. Turns sort by turn, then role and text, so ties and repeated
    rows have one order; null turns come first. Null roles and texts count as empty. A null conv_id is a
    conversation of its own. The loss mask covers each text of ``loss_role``, escapes included, no marks.
    """
    empty = F.lit("")
    held = (
        turns.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")))).alias("turns"))
        .withColumn("roles", F.col("turns.role"))
    )
    n = F.size("turns")
    role_before = F.concat(F.array(F.lit(None).cast("string")), F.slice("roles", F.lit(1), n - 1))
    with_before = F.arrays_zip(F.col("turns").alias("t"), role_before.alias("before"))
    piece = lambda z: F.struct(
        F.when(z["t"]["role"] == z["before"], F.lit(NEXT))
        .otherwise(F.concat(F.when(z["before"].isNull(), empty).otherwise(F.lit(END)), F.lit(START), escape(z["t"]["role"]), F.lit(BODY)))
        .alias("mark"),
        escape(z["t"]["text"]).alias("text"),
        (z["t"]["role"] == loss_role).alias("loss"),
    )
    pieces = held.select("conv_id", F.transform(with_before, piece).alias("pieces"))
    span = "struct<start:bigint,length:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["mark"])
        one = F.array(F.struct(at.alias("start"), F.length(p["text"]).cast("long").alias("length")))
        return F.struct((at + F.length(p["text"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(END))
    return pieces.select(
        "conv_id",
        text.alias("formatted"),
        F.aggregate("pieces", start, walk, lambda acc: acc["spans"]).alias("loss_spans"),
        F.size(F.filter("pieces", lambda p: p["mark"] != NEXT)).cast("long").alias("n_blocks"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        halves = F.split(block, r"<\|body\|>", 2)
        role = unescape(F.substring_index(F.get(halves, F.lit(0)), START, -1))
        return F.transform(F.split(F.get(halves, F.lit(1)), r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
