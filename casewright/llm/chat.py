"""Chat formatting with Spark expressions only: sort collected turns, merge neighbours of one role, concatenate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, BREAK = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_nl|>"


def escape(text: Column) -> Column:
    r"""Reversible: backslashes double, then `<|` becomes `<\|`; no control string is left in a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (array of struct(start, chars), code points, start
    from 0): the places of the loss_role's escaped texts, one each, in order.

    Turns are sorted by (turn, role, text), nulls first; null text or role: empty. Neighbouring turns of one role share
    a block, with a separator between their texts, so each turn can be read back. A null conv_id is a conversation of
    its own. Repeated rows stay. Other columns are not read; an empty table gives an empty result. A conversation is
    one string, so it must fit a row; conversations never meet in a task's memory.
    """
    turn = F.struct(
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    got = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), turn.alias("t"))
    got = got.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    got = got.withColumn(
        "heads",
        F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])),
    )
    block = F.transform(
        "heads",
        lambda h, j: F.struct(
            F.get("turns", h)["role"].alias("role"),
            F.transform(F.slice("turns", h + 1, F.coalesce(F.get("heads", j + 1), F.size("turns")) - h), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    got = got.withColumn("blocks", block)
    head = lambda b: F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), F.lit(END + "\n"))), "")
    # what stands before each text: a block's head, or a separator
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, k: F.struct(
                    (F.when(k == 0, F.length(head(b))).otherwise(len(SEP))).cast("long").alias("before"),
                    F.length(t).cast("long").alias("chars"),
                    F.when(k == F.size(b["texts"]) - 1, len(END) + 1).otherwise(0).cast("long").alias("after"),
                    (b["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,chars:bigint>>)").alias("spans"))
    spans = F.aggregate(
        "pieces",
        zero,
        lambda acc, p: F.struct(
            (acc["at"] + p["before"] + p["chars"] + p["after"]).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["before"]).alias("start"), p["chars"].alias("chars"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    got = got.withColumn("pieces", pieces)
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), whole.alias("formatted"), spans.alias("loss"))


def parse_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substring(b, F.length(role) + 2, F.length(b) - F.length(role) - 2 - len(END))
        name = unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["chars"].cast("int")))), "")


def chat_digest(df: DataFrame, **cols: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_chats' output."""
    out = format_chats(df, **cols)
    out = out.select("conv_id", "formatted", parse_chats(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("under"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
