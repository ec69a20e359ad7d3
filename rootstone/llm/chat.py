"""Chat formatting: cumulative snapshots of a conversation collapse to the maximal one, which is rendered.

A logged conversation is a snapshot if all its turns, in order, are the first turns of a longer one. Each turn has a hash of
its place, role and text; their running sums are prefix hashes. Whole-conversation hashes are anti-joined with the distinct
hashes of proper prefixes; of equal conversations the least id stays.

Semantics. Turns are ordered by turn (null first), role, text; their places count from 0, whatever the turn numbers. Null role and text
differ from empty ones when compared, and are rendered as "unknown" and "". Rows that repeat a turn are turns of their own. Rows with null
conv_id form one conversation with null id. Prefixes are told apart by two 64-bit sums and the length. Extra columns are not read.
The texts are shuffled once to their conversations and once, rendered, to what stays. All of it is DataFrame operations; prefix hashes are made distinct before they are dealt out, so common first turns are no hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

START, END = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: int) -> Column:
    null_marks = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    return F.xxhash64(F.lit(seed), F.col("place"), F.col("role"), F.col("text"), null_marks)


def _wrapping_sum(of: Column, window) -> Column:
    """Running sum modulo 2^62 of non-negative parts, which no mode of arithmetic rejects."""
    return F.pmod(F.sum(F.pmod(of, F.lit(1 << 62)).cast("decimal(38,0)")).over(window), F.lit(1 << 62).cast("decimal(38,0)")).cast("long")


def conversations_of(turns: DataFrame, start: str, end: str) -> DataFrame:
    """Per conversation, in one shuffle of the turns: conv_id, rendered, n (turns), a and b (hashes of all of it), and proper, the hashes of its
    proper prefixes."""
    whole = Window.partitionBy("conv_id")
    ordered = whole.orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    placed = turns.select("conv_id", "turn", "role", "text", (F.row_number().over(ordered) - 1).alias("place"))
    hashed = placed.select("conv_id", "place", "role", "text", _turn_hash(1).alias("x"), _turn_hash(2).alias("y"))
    running = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    line = F.concat(F.lit(start), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end))
    summed = hashed.select("conv_id", "place", line.alias("line"), _wrapping_sum(F.col("x"), running).alias("a"), _wrapping_sum(F.col("y"), running).alias("b"))
    listed = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "line", "a", "b"))).alias("turns"))
    last, n = F.element_at("turns", -1), F.size("turns")
    return listed.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["line"]), "\n").alias("rendered"), n.cast("long").alias("n"), last["a"].alias("a"), last["b"].alias("b"),
        F.transform(F.slice("turns", F.lit(1), n - 1), lambda t: F.struct((t["place"] + 1).cast("long").alias("n"), t["a"], t["b"])).alias("proper"),
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv_id, n, a, b, n_equal) of the conversations that stay. hashes: conv_id, n, a, b, proper."""
    wholes = hashes.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    proper = hashes.select(F.explode("proper").alias("p")).select("p.*").distinct()
    return wholes.join(proper, ["n", "a", "b"], "left_anti")


def collapse(conversations: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """One row per conversation that stays: conv_id, n_turns, n_equal (conversations that equal it, itself included), rendered."""
    turns = conversations.select(
        conversations["conv_id"], conversations["turn"], conversations["role"].cast("string").alias("role"), conversations["text"].cast("string").alias("text")
    )
    every = staged(conversations_of(turns, start, end), "chat-conversations")
    stay = maximal(every.select("conv_id", "n", "a", "b", "proper")).toDF("n", "a", "b", "kept_id", "n_equal")
    texts = every.select("conv_id", "rendered", "n", "a", "b")
    joined = texts.join(stay, ["n", "a", "b"]).where(F.col("conv_id").eqNullSafe(F.col("kept_id")))
    return joined.select("conv_id", F.col("n").alias("n_turns"), "n_equal", "rendered")
