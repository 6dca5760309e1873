"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

Loggers often write a conversation again after every exchange, so that one log holds all its prefixes. Every turn gets
two 64-bit hashes of its number, role and text; exclusive-or over the turns so far gives a rolling prefix hash. A
conversation whose whole hash equals a proper prefix hash of another is dropped by an anti-join, and of equal
conversations the smallest id stays, with the number of its copies. The maximal ones are rendered to chat markup.

The rolling hash is taken in two levels, over turns in blocks of `BLOCK_TURNS` numbers and over blocks, and a
conversation is rendered in parts of one block each, so no task needs a whole conversation, however many rows it has;
whole hashes are plain sums. Joining the parts of a conversation in order gives its whole text.

Defined cases: turns count by their number and gaps stay; several rows of one number are a set of turns, in order of
role and text; null numbers come last, as a turn of their own; a null role is rendered as `unknown`, a null text as
empty; rows with a null conversation id form one conversation with that id; an empty table gives no rows; control
marks inside a text (`<|`) are spaced apart; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.common import cut

BLOCK_TURNS = 256
_KEY = ("rows_so_far", "x1", "x2")


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, block: int) -> DataFrame:
    turn = F.col(turn_col).cast("long")
    return conversations.select(
        F.struct(F.col(conv_col).isNull().alias("none"), F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("id")).alias("conv"),
        F.struct(turn.isNull().alias("last"), F.coalesce(turn, F.lit(0)).alias("number")).alias("turn"),
        F.struct(turn.isNull().alias("last"), F.floor(F.coalesce(turn, F.lit(0)) / block).cast("long").alias("number")).alias("part"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )


def _rolled(turns: DataFrame) -> DataFrame:
    """Every turn number of every conversation with its rolling prefix hash and the conversation's whole one."""
    big = lambda c: c.cast("decimal(20,0)")
    known = F.struct(F.col("role").isNull(), F.col("text").isNull(), "role", "text")
    steps = turns.groupBy("conv", "part", "turn").agg(
        F.count("*").alias("n"), F.sum(big(F.xxhash64(known))).alias("s1"), F.sum(big(F.xxhash64(F.lit("second"), known))).alias("s2"),
    ).select("conv", "part", "turn", "n", F.xxhash64("turn", "n", "s1", "s2").alias("k1"), F.xxhash64("s2", "s1", "n", "turn").alias("k2"))
    total = lambda w: (F.sum("n").over(w).alias("n"), F.bit_xor("k1").over(w).alias("k1"), F.bit_xor("k2").over(w).alias("k2"))
    within = Window.partitionBy("conv", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    parts = steps.groupBy("conv", "part").agg(F.sum("n").alias("n"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    ahead = parts.select(
        "conv", "part", F.struct(*total(before)).alias("before"), F.struct(*total(whole)).alias("whole"))
    start = lambda c: F.coalesce(F.col(f"before.{c}"), F.lit(0).cast("long"))
    return steps.select("conv", "part", "turn", *total(within)).join(ahead, ["conv", "part"]).select(
        "conv", "part", "turn", (F.col("n") + start("n")).alias(_KEY[0]), F.col("k1").bitwiseXOR(start("k1")).alias(_KEY[1]),
        F.col("k2").bitwiseXOR(start("k2")).alias(_KEY[2]), "whole")


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv, part, n_copies): the blocks of the conversations that no other one continues."""
    ends = rolled.where(F.col(_KEY[0]) == F.col("whole.n")).groupBy(*_KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    proper = rolled.where(F.col(_KEY[0]) < F.col("whole.n")).select(*_KEY).distinct()
    kept = ends.join(proper, list(_KEY), "left_anti").select("conv", "n_copies")
    return rolled.select("conv", "part").distinct().join(kept, "conv")


def format_chats(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", block: int = BLOCK_TURNS,
) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text) of every maximal conversation; parts count from 0."""
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col, block)
    rolled = cut(_rolled(turns))
    kept = maximal(rolled)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(
        F.lit("<|im_start|>"), F.coalesce(m["role"], F.lit("unknown")), F.lit("\n"),
        F.replace(F.coalesce(m["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n")))
    text = turns.join(kept, ["conv", "part"]).groupBy("conv", "part").agg(
        F.count("*").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(lines, "").alias("text"))
    order = Window.partitionBy("conv").orderBy("part")
    numbers = kept.select("conv", "part", (F.row_number().over(order) - 1).alias("place"))
    return text.join(numbers, ["conv", "part"]).select(
        F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"), F.col("place").cast("long").alias("part"),
        "n_turns", "n_copies", "text")
