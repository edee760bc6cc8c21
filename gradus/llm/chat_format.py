"""Chat formatting by prefix-target expansion: an example for every assistant turn.

An example is the formatted text of all turns before the reply, the reply, and the span of the reply's text: the loss mask.
Turns after the last reply stand in a last example without a target, so that the examples hold the whole conversation.

A formatted turn is ``### role: text </turn>`` and a line feed. Inside roles and texts, backslash, ``#`` and ``<`` are
written ``\\b``, ``\\h`` and ``\\l``, in roles also ``:`` as ``\\c``: no text can hold a marker, and unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import written

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
TARGET = "assistant"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, target, formatted, loss_start, loss_end) from ``turns`` (conv_id, turn, role, text).

    Rows go by turn, nulls first; equal turns by role, then text. Null roles and texts are empty. Rows with a null conv_id are
    one conversation. ``target`` counts turns from 0; the loss span is in code points, end exclusive, and empty in the example
    without a target, whose ``target`` is the number of turns. Repeated rows are turns of their own; an empty table has no examples.
    Each example repeats all turns before its target, so a conversation's output grows with the square of its replies.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    role = lambda t: F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c"))
    head = lambda t: F.concat(F.lit(OPEN), role(t), F.lit(MIDDLE))
    talks = talks.select(
        "conv_id", F.size("turns").alias("n"), "turns", F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))).alias("parts"),
    )
    at = F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: F.when(i < F.col("n"), F.get("turns", i)["role"] == TARGET).otherwise(F.element_at("turns", -1)["role"] != TARGET))
    one = talks.select("conv_id", "n", "turns", "parts", F.explode(at).alias("target"))
    end = F.length("formatted") - len(CLOSE)
    reply = F.when(F.col("target") < F.col("n"), F.length(escape(F.get("turns", F.col("target"))["text"]))).otherwise(0)
    return one.select(
        "conv_id", "target", F.array_join(F.slice("parts", 1, F.least(F.col("target") + 1, F.col("n"))), "").alias("formatted"), reply.alias("reply"),
    ).select("conv_id", "target", "formatted", (end - F.col("reply")).alias("loss_start"), end.alias("loss_end"))


def parse(examples: DataFrame) -> DataFrame:
    """``expand`` undone, from formatted text alone: adds ``turns``, an array of (role, text), and ``loss``, the text under the mask."""
    parts = F.split(F.expr("substring(formatted, 1, length(formatted) - %d)" % len(CLOSE)), CLOSE)
    turn = lambda p: F.struct(
        unescape(F.replace(F.substr(p, F.lit(len(OPEN) + 1), F.locate(MIDDLE, p) - len(OPEN) - 1), F.lit("\\c"), F.lit(":"))).alias("role"),
        unescape(F.substr(p, F.locate(MIDDLE, p) + len(MIDDLE))).alias("text"),
    )
    loss = F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return examples.withColumns({"turns": F.transform(parts, turn), "loss": unescape(loss)})


def format_digest(turns: DataFrame) -> DataFrame:
    """The contract's columns, read back from the written examples."""
    examples = written(expand(turns), "examples")
    said = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    per = parse(examples).select(
        "conv_id", "target", F.size("turns").alias("n"), F.array_join(F.transform("turns", said), "").alias("said"), "loss", F.length("formatted").alias("chars"),
    )
    losses = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "loss"))), lambda x: x["loss"]), "")
    return per.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max_by("said", "n").alias("said"), losses.alias("losses"),
        F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"),
    ).select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("losses").cast("long").alias("loss_chars"),
        F.sha2("losses", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
