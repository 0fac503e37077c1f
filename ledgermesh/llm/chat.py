"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only its
reply is trainable. Turns after the last assistant turn (all turns, where there is none) would be in no
example, so they go out as one further example without a target.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. In roles and texts every ``<``, any
number of ``~`` and ``|`` gets one more ``~``, so no control string can appear there; taking one ``~`` off
restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, turns array)`` in order of turn, then role and text.

    Null roles and texts count as empty. Repeated rows are turns of their own; a null conv_id is an id like
    any other, a null turn comes first.
    """
    item = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))


def examples(turns: DataFrame) -> DataFrame:
    """``(conv_id, example, context, target, formatted, has_target)``: a row for each assistant turn.

    ``formatted`` is context and target joined; the loss mask covers just the code points of ``target``
    before its end marker, from ``loss_start`` to ``loss_end``.
    """
    one = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END))
    made = conversations(turns).select("conv_id", "turns", F.transform("turns", one).alias("shown"))
    answers = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i.cast("int"))["role"] == "assistant")
    last = F.coalesce(F.try_element_at("answers", F.lit(-1)), F.lit(0))
    targets = F.when(last < F.size("turns"), F.concat("answers", F.array(-F.size("turns")))).otherwise(F.col("answers"))
    made = made.withColumn("answers", answers.cast("array<int>")).withColumn("at", F.explode(targets.cast("array<int>")))
    made = made.withColumn("has_target", F.col("at") > 0)
    whole = F.array_join(F.slice("shown", F.lit(1), F.abs("at")), "")
    opened = F.concat(F.array_join(F.slice("shown", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0))), ""), F.lit(START + "assistant" + SEP))
    made = made.withColumn("formatted", whole)
    start = F.when(F.col("has_target"), F.length(opened))
    return made.select("conv_id", F.abs("at").alias("example"), "has_target", "formatted", start.alias("loss_start"), F.when(F.col("has_target"), F.length("formatted") - len(END)).alias("loss_end"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.regexp_replace(p, r"^<\|im_start\|>", ""), SEP, 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^<\|im_start\|>.*?<\|im_sep\|>", "")).alias("text"),
        ),
    )


def read_back(rows: DataFrame) -> DataFrame:
    """What the examples hold, for each conversation: turns from the longest one, text under the loss masks of all."""
    masked = unescape(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)"))
    grouped = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("has_target"), F.struct("example", masked.alias("loss"))))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count_if("has_target").alias("n_examples"),
    )
    turns = grouped.withColumn("turns", parsed(F.col("longest")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
