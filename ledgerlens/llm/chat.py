"""Chat formatting with Spark expressions only.

A conversation becomes one text:

    <s> (\\n<|start|> role \\n<|message|> text (\\n<|next|> text)* \\n<|end|>)* \\n</s>

Adjacent turns of one role share a block; `<|next|>` keeps them apart, so the
turns can be read back. Marks always follow a line feed (or begin the text).
Control strings inside roles and texts get one backslash more than twice the
backslashes that stand before them, so none of them follows a line feed
directly, and the change can be undone.

Defined cases: null text and null role are empty; turns are ordered by (turn,
role, text), nulls first, and repeated rows stay repeated turns; rows without
conv_id form one conversation; an empty table gives no rows; other columns are
ignored. A conversation is one row of the result, so its turns meet in one task;
the offsets of the loss mask are added up over its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the control strings of the template, and those of other templates ---------
CONTROLS = ("<s>", "</s>", "<|start|>", "<|message|>", "<|next|>", "<|end|>", "[INST]", "[/INST]")
# ---------------------------------------------------------------------------------------------
OPEN, CLOSE = "<s>", "\n</s>"
START, MESSAGE, NEXT, END = "\n<|start|>", "\n<|message|>", "\n<|next|>", "\n<|end|>"
_QUOTED = "|".join("".join("\\" + ch if not ch.isalnum() else ch for ch in c) for c in CONTROLS)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({_QUOTED})", r"$1$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)\1\\({_QUOTED})", "$1$2")


def formatted(conversations: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss_mask: [start, end) code points of every text of `learned_role`."""
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # head: what stands before the text of a turn; body: the escaped text
    turns = turns.withColumn("turns", F.transform("turns", lambda t, i: F.struct(
        t["role"].alias("role"), escaped(t["text"]).alias("body"),
        ((i > 0) & (F.get("turns", i - 1)["role"] == t["role"])).alias("again"), (i > 0).alias("later"))))
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(
        F.when(t["again"], F.lit(NEXT)).otherwise(F.concat(
            F.when(t["later"], F.lit(END)).otherwise(F.lit(OPEN)), F.lit(START), escaped(t["role"]), F.lit(MESSAGE),
        )).alias("head"), t["body"].alias("body"), (t["role"] == learned_role).alias("learned"))))
    text = F.concat(
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), ""), F.lit(END), F.lit(CLOSE))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(state, t):
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["learned"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    mask = F.aggregate(
        "turns", F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), add, lambda s: s["spans"])
    return turns.select("conv_id", text.alias("formatted"), mask.alias("loss_mask"))


def read_back(text: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    inner = F.substring(text, len(OPEN) + 1, F.length(text) - len(OPEN) - len(CLOSE))
    # a block is START role MESSAGE text (NEXT text)* END
    blocks = F.filter(F.split(inner, _literal(END), -1), lambda b: F.startswith(b, F.lit(START)))

    def turns(block):
        parts = F.split(block, _literal(MESSAGE), 2)
        role = unescaped(F.substring(F.get(parts, F.lit(0)), len(START) + 1, 2**31 - 1))
        return F.transform(F.split(F.get(parts, F.lit(1)), _literal(NEXT), -1), lambda t: F.struct(
            role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(text: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped and joined without anything between."""
    return F.array_join(F.transform(loss_mask, lambda s: unescaped(
        F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def _literal(mark: str) -> str:
    return "".join(ch if ch.isalnum() or ch == "\n" else "\\" + ch for ch in mark)
