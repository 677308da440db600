"""Chat formatting with collapse of cumulative snapshots; DataFrame functions only.

A logged conversation that is a prefix of a longer one is a snapshot of it and goes; of identical
ones the smallest id stays. Each turn has a hash; the running XOR of the hashes of turns up to it,
in two lanes of 64 bits, with their number, is the rolling hash of that prefix. A conversation's own
hash is anti-joined with the proper prefixes of all. Both sides have one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024  # turns of one conversation that are numbered in one task


def turns(conversations: DataFrame) -> DataFrame:
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    said = F.concat(F.coalesce(F.concat(F.lit("r"), "role"), F.lit("-")), F.lit("|"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-")))
    return t.withColumn("hash", F.md5(said.cast("binary")))


def prefixes(t: DataFrame) -> DataFrame:
    """conv_id, n, a, b, whole: the rolling hash after each turn; whole: after the last.

    Turns are numbered in blocks of BLOCK turn numbers, and the blocks' totals are carried over, so that
    a very long conversation is spread over many tasks.
    """
    tag = [F.coalesce("turn", F.lit(-1)), F.col("turn").isNull(), F.col("hash")]
    h = t.select("conv_id", "turn", "hash", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(1 << 60)).alias("block"), F.xxhash64(*tag).alias("x"), F.xxhash64(F.lit(7), *tag).alias("y"))
    own = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_last("turn"), "hash")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = h.select("conv_id", "block", F.count("*").over(run).alias("k"), F.bit_xor("x").over(run).alias("xk"), F.bit_xor("y").over(run).alias("yk"), F.lead(F.lit(1)).over(own).isNull().alias("last"))
    over = Window.partitionBy("conv_id").orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("bl"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("x0"),
        F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("y0"), F.lead(F.lit(1)).over(over).isNull().alias("end"),
    )
    return rows.join(blocks, rows.conv_id.eqNullSafe(blocks.c) & (rows.block == blocks.bl)).select(
        "conv_id", (F.col("k") + F.col("n0")).alias("n"), F.col("xk").bitwiseXOR(F.col("x0")).alias("a"), F.col("yk").bitwiseXOR(F.col("y0")).alias("b"), (F.col("last") & F.col("end")).alias("whole"),
    )


def maximal(t: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no other one extends or repeats."""
    # one row for each prefix, as a whole conversation (its smallest id) or as a proper prefix of one
    p = prefixes(t).groupBy("a", "b", "n").agg(F.min(F.when(F.col("whole"), F.col("conv_id"))).alias("conv_id"), F.bool_or("whole").alias("is_whole"), F.bool_or(~F.col("whole")).alias("is_part"))
    whole, part = p.where("is_whole").select("a", "b", "n", "conv_id"), p.where("is_part").select("a", "b", "n")
    return whole.join(part, ["a", "b", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def format_chats(conversations: DataFrame, opening: str = "<|%s|>\n", closing: str = "\n") -> DataFrame:
    """conv_id, n_turns, rendered: the maximal conversations, turns in order, each as opening % role, text, closing.

    Turns go by number (null last), ties by an MD5 of role and text; the number is part of a turn, so a
    prefix has the same numbers. Identical rows count once. A null conv_id is a conversation like any
    other (its id counts as the largest); a null role or text is rendered empty, and differs from an empty one
    in comparisons. An empty table yields no rows; other columns aren't read.
    Very long texts are hashed and rendered whole; a conversation's rendering is one row, whatever its length.
    Only a kept conversation's own turns are gathered, into the one row they make.
    """
    t = turns(conversations)
    keep = maximal(t).select(F.col("conv_id").alias("kept"), "n_turns")
    head, _, tail = opening.partition("%s")
    line = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(tail), F.coalesce("text", F.lit("")), F.lit(closing))
    both = t.join(keep, t.conv_id.eqNullSafe(keep.kept)).select("conv_id", "n_turns", F.struct(F.col("turn").isNull().alias("o"), "turn", "hash", line.alias("line")).alias("s"))
    rows = both.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select("conv_id", "n_turns", F.array_join(F.transform("s", lambda s: s.line), "").alias("rendered"))
