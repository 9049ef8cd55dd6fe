"""Operator 5: chat formatting as relational algebra, in Spark SQL expressions only.

The turns of a conversation are collected as structs and sorted; an ``aggregate`` over the
array merges adjacent turns of one role into a block, and blocks are concatenated:

    <s>ROLE\\nTEXT</s>            one turn
    <s>ROLE\\nTEXT<sep>TEXT</s>   adjacent turns of one role

Control strings (``<s>``, ``</s>``, ``<sep>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``,
``<</SYS>>``) never appear inside escaped text: a backslash is put behind their first
character, and backslashes are doubled; a line break in a role is written as a backslash and
``n``. Undoing all, from left to right, is exact.

The loss mask covers what an assistant says, without role, separators and end marks: spans
of (start, length) in code points of the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, SEP, END = "<s>", "<sep>", "</s>"
LOSS_ROLE = "assistant"
_CONTROL = r"<(?=/?s>|sep>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    """An escaped role without line breaks, which end the role. No control string starts with
    ``n``, so a single backslash before it stands for a line break alone."""
    return F.regexp_replace(escape(role), "\n", r"\\n")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_mask): one row per conversation.

    Turns go by turn number, nulls first; ties by role and text, so repeated rows all appear.
    Null roles and texts are empty. Rows without a conversation id form one conversation.
    Roles are escaped like texts, line breaks in them too. An empty table gives no rows; other
    columns are not read."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    merged = sorted_turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")))
        .alias("turns"))
    # Every turn knows what stands before and behind its text: this is the merge.
    pieces = merged.select("conv_id", F.transform("turns", lambda t, i: F.struct(
        F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(SEP))
        .otherwise(F.concat(F.lit(BEGIN), t["role"], F.lit("\n"))).alias("before"),
        t["text"].alias("text"), t["loss"].alias("loss"),
        F.when(F.get("turns", i + 1)["role"] == t["role"], F.lit("")).otherwise(F.lit(END)).alias("behind")))
        .alias("pieces"))
    whole = pieces.select("conv_id", "pieces", F.array_join(F.transform("pieces", lambda p: F.concat(
        p["before"], p["text"], p["behind"])), "").alias("formatted"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>")
                    .alias("spans"))
    return whole.select("conv_id", "formatted", F.aggregate("pieces", zero, lambda a, p: F.struct(
        (a["at"] + F.length(p["before"]) + F.length(p["text"]) + F.length(p["behind"])).alias("at"),
        F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(
            (a["at"] + F.length(p["before"])).alias("start"), F.length(p["text"]).cast("long").alias("length")))))
        .otherwise(a["spans"]).alias("spans")), lambda a: a["spans"]).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) from (conv_id, formatted, loss_mask): the turns as structs of
    role and text, merged ones apart again, and the unescaped texts under the mask."""
    blocks = formatted.select("conv_id", "formatted", "loss_mask", F.filter(
        F.split("formatted", END), lambda b: b != "").alias("blocks"))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(
        F.split(F.substr(b, F.instr(b, "\n") + 1), SEP), lambda x: F.struct(
            unescape_role(F.substr(b, F.lit(len(BEGIN) + 1), F.instr(b, "\n") - len(BEGIN) - 1)).alias("role"),
            unescape(x).alias("text")))))
    return blocks.select("conv_id", "formatted", turns.alias("turns"), F.transform("loss_mask", lambda m: unescape(
        F.substr("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int")))).alias("loss_texts"))


def digests(back: DataFrame) -> DataFrame:
    """The digest columns of what was read back."""
    loss = F.array_join("loss_texts", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
