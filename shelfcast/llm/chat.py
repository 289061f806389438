"""Conversations as training text with a loss mask, by DataFrame functions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into
a block.  A block is written as

    user       <s>[INST]text[/INST]</s>
    assistant  <s>text</s>
    others     <s>[ROLE]role[/ROLE]text</s>

and the merged texts of a block stand apart by ``[SEP]``.  A text that holds one of these strings gets a
backslash after the string's bracket, and one more if some stand there, so reading back is exact.

Edge cases: null texts and roles are empty; turns are ordered by number, then role and text, a null number
first; repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty
result.  Columns beside the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings.
BEGIN, END, SEP = "<s>", "</s>", "[SEP]"
USER, USER_END, ROLE, ROLE_END = "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"
CONTROL = r"(/?(?:s>|INST\]|ROLE\]|SEP\]))"
SPAN = "array<struct<start:bigint,length:bigint>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", "$1$2$3")


def _blocks(turns: Column) -> Column:
    """Role and texts of each run of turns with one role."""
    n = F.size(turns)
    first = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])
    )
    return _once(
        first,
        lambda at: F.transform(
            at,
            lambda s, k: F.struct(
                F.get(turns, s)["role"].alias("role"),
                F.transform(F.slice(turns, s + 1, F.coalesce(F.get(at, k + 1), n) - s), lambda t: t["text"]).alias("texts"),
            ),
        ),
    )


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _written(block: Column) -> Column:
    """The pieces of a block, those under the loss marked."""
    role, no = block["role"], F.lit(False)
    opening = (
        F.when(role == "user", F.lit(BEGIN + USER))
        .when(role == "assistant", F.lit(BEGIN))
        .otherwise(F.concat(F.lit(BEGIN + ROLE), escaped(role), F.lit(ROLE_END)))
    )
    closing = F.when(role == "user", F.lit(USER_END + END)).otherwise(F.lit(END))
    body = F.flatten(
        F.transform(
            block["texts"],
            lambda t, k: F.array(
                _piece(F.when(k > 0, F.lit(SEP)).otherwise(F.lit("")), no), _piece(escaped(t), role == "assistant")
            ),
        )
    )
    return F.concat(F.array(_piece(opening, no)), body, F.array(_piece(closing, no)))


def _spans(pieces: Column) -> Column:
    """Start (from 0) and length of each piece under the loss."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        size = F.length(piece["text"]).cast("bigint")
        own = F.array(F.struct(state["at"].alias("start"), size.alias("length")))
        return F.struct(
            (state["at"] + size).alias("at"), F.when(piece["loss"], F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans")
        )

    return F.aggregate(pieces, start, add, lambda s: s["spans"])


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and spans (start and length of each text under the loss, in code points)."""
    own = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = _once(F.col("turns"), lambda t: F.flatten(F.transform(_blocks(t), _written)))
    done = F.struct(
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), _spans(F.col("pieces")).alias("spans")
    )
    return sorted_turns.select("conv_id", pieces.alias("pieces")).select("conv_id", done.alias("d")).select("conv_id", "d.formatted", "d.spans")


def read_back(formatted: Column) -> Column:
    """The turns (role and text) of a formatted conversation."""
    ended = F.split(formatted, END)
    blocks = F.slice(ended, 1, F.size(ended) - 1)

    def read(block: Column) -> Column:
        body = F.substr(block, F.lit(len(BEGIN) + 1))
        is_user, is_other = F.startswith(body, F.lit(USER)), F.startswith(body, F.lit(ROLE))
        split = F.instr(body, ROLE_END)
        role = (
            F.when(is_user, F.lit("user"))
            .when(is_other, unescaped(F.substr(body, F.lit(len(ROLE) + 1), split - len(ROLE) - 1)))
            .otherwise(F.lit("assistant"))
        )
        inner = (
            F.when(is_user, F.substr(body, F.lit(len(USER) + 1), F.length(body) - len(USER) - len(USER_END)))
            .when(is_other, F.substr(body, split + len(ROLE_END)))
            .otherwise(body)
        )
        return F.transform(
            F.split(inner, r"\[SEP\]"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, read))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss, as it was before escaping."""
    return F.array_join(
        F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
