"""Logged conversations collapsed to the longest of each series of snapshots, and rendered.

A conversation is the turns of one ``conv_id`` in order of ``turn`` (then role, then text). A chat log often holds the
same conversation many times, each snapshot a few turns longer. The rolling hash of a prefix of ``k`` turns is a pair of
sums over its turns' hashes, each salted with the turn's place, so that the running sum at each turn is the prefix's
hash.

1. Places by a sort in two levels, prefix hashes by running sums over blocks of turns: a conversation, or the rows
   without ``conv_id``, of any share of the table is spread over tasks.
2. Conversations whose own hash is among the hashes of proper prefixes are snapshots of longer ones: an anti-join on
   (length, hash) with the distinct proper prefixes removes them. A first turn that many share is one such row.
3. Of conversations that are equal, the smallest ``conv_id`` stays: grouping by hash.
4. What remains is rendered turn by turn; ``PART`` turns make one output row, so that a row's size is bounded.

Everything is DataFrame functions.

Rows: a null role or text is empty; a null turn comes first; rows without ``conv_id`` are one conversation of id null;
a repeated row is a turn of its own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import NO_ID, materialize
from mediacat.operators.ordered import Running, places, running

#: Turns of a rendered row.
PART = 64
#: Letters of a text that sort keys hold, and turns whose hashes one task sums up.
START, BLOCK = 64, 10_000
HALF = 2**31 - 1


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every turn with its place from 1 and the hash (a, b) of the conversation up to it."""
    turns = _turns(conversations).withColumn("_same", F.lit(0))
    start = F.struct("turn", "role", F.substring("text", 1, START).alias("start"))
    order = (F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    placed = places(turns, "conv_id", start, "_same", order=order, draw=F.xxhash64("conv_id", "turn", "role", "text")).drop("_same")
    salted = lambda salt: Running("sum", F.xxhash64(F.lit(salt), "place", "role", "text").bitwiseAND(F.lit(HALF)))
    return running(placed, ["conv_id"], "place", {"a": salted(1), "b": salted(2)}, BLOCK)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal of conversations that are no proper prefix of another, the smallest id of equal ones."""
    whole = turns.groupBy("conv_id").agg(F.max(F.struct("place", "a", "b")).alias("w")).select("conv_id", "w.*")
    equal = whole.groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    ends = whole.groupBy("place", "a", "b").agg(F.count(F.lit(1)).alias("ends"))
    passed = turns.groupBy("place", "a", "b").agg(F.count(F.lit(1)).alias("reached"))
    proper = passed.join(ends, ["place", "a", "b"]).where("reached > ends").select("place", "a", "b")
    return equal.join(proper, ["place", "a", "b"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """Maximal conversations in parts: conv_id, part, n_turns, n_equal, rendered."""
    turns = materialize(prefixes(conversations), "turns")
    kept = turns.join(maximal(turns.select("conv_id", "place", "a", "b")), "conv_id")
    piece = F.struct("place", render_turn(F.col("role"), F.col("text")).alias("t"))
    part = F.floor((F.col("place") - 1) / PART).cast("long")
    parts = kept.groupBy("conv_id", part.alias("part")).agg(F.first("n_turns").alias("n_turns"), F.first("n_equal").alias("n_equal"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return parts.select(F.nullif("conv_id", F.lit(NO_ID)).alias("conv_id"), "part", "n_turns", "n_equal", F.array_join(F.transform("pieces", lambda x: x["t"]), "").alias("rendered"))
