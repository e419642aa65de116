"""Chat formatting: logged snapshots of a conversation collapse into the longest one, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Turn numbers that are put in order together; a longer conversation is ordered block by block.
TURNS = 256


def _said(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def _turns(conversations: DataFrame) -> DataFrame:
    """Each distinct turn with its place in its conversation and two 64-bit hashes of all turns up to it.

    A rolling hash is the exclusive-or of the hashes of (place, role, text), so the hashes of the
    blocks of a long conversation combine.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    role, text = F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00"))
    narrow = (
        conversations.where("conv_id IS NOT NULL")
        .select("conv_id", turn.alias("turn"), F.xxhash64(role, text).alias("x"), F.xxhash64(text, F.lit(1), role).alias("y"))
        .distinct().withColumn("block", F.floor(F.col("turn") / TURNS))
    )
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "x", "y")
    blocks = narrow.groupBy("conv_id", "block").count()
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("count")
    n = F.sum("count").over(Window.partitionBy("conv_id"))
    placed = (
        narrow.withColumn("place", F.row_number().over(within))
        .join(blocks.select("conv_id", "block", before.alias("before"), n.alias("n_turns")), ["conv_id", "block"])
        .withColumn("place", F.col("place") + F.col("before"))
        .withColumn("hx", F.xxhash64("place", "x", "y")).withColumn("hy", F.xxhash64("y", "place", "x"))
    )
    sums = placed.groupBy("conv_id", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        "conv_id", "block", F.coalesce(F.bit_xor("bx").over(earlier), F.lit(0).cast("long")).alias("cx"),
        F.coalesce(F.bit_xor("by").over(earlier), F.lit(0).cast("long")).alias("cy"),
    )
    so_far = Window.partitionBy("conv_id", "block").orderBy("place")
    return placed.join(carried, ["conv_id", "block"]).select(
        "conv_id", "turn", "x", "y", "place", "n_turns",
        F.bit_xor("hx").over(so_far).bitwiseXOR(F.col("cx")).alias("px"),
        F.bit_xor("hy").over(so_far).bitwiseXOR(F.col("cy")).alias("py"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of the conversations that are no prefix of a longer one.

    Of equal conversations the smallest conv_id stays; ``n_copies`` counts them. Turns are ordered
    by number, then by content; a null turn number comes first, and exact repeats of a turn are one
    turn. Null roles and texts are values of their own. Rows with a null conv_id belong to no
    conversation and are left out.
    """
    return _kept(_turns(conversations))


def _kept(turns: DataFrame) -> DataFrame:
    whole = (
        turns.where("place = n_turns").groupBy("n_turns", "px", "py")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    begun = turns.where("place < n_turns").select(F.col("place").cast("long").alias("n_turns"), "px", "py").distinct()
    return whole.join(begun, ["n_turns", "px", "py"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, segment, n_turns, n_copies, text)``: the maximal conversations as chat text.

    A turn is ``<|role|>``, its text and ``<|end|>`` on lines of their own (null role: ``unknown``,
    null text: empty). Each segment holds up to ``TURNS`` turns, so one row stays small however long
    its conversation is; segment 0 is the whole of all shorter ones.
    """
    turns = _turns(conversations)
    kept = _kept(turns)
    role, text = F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00"))
    said = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.xxhash64(role, text).alias("x"), F.xxhash64(text, F.lit(1), role).alias("y"),
        _said(F.col("role"), F.col("text")).alias("said"),
    )
    placed = turns.join(kept.select("conv_id", "n_copies"), "conv_id").select("conv_id", "turn", "x", "y", "place", "n_turns", "n_copies")
    joined = said.join(placed, ["conv_id", "turn", "x", "y"])
    # A turn that was logged twice arrives twice; the first of equal structs is kept by the set.
    parts = F.array_sort(F.collect_set(F.struct("place", "said")))
    return (
        joined.groupBy("conv_id", F.floor((F.col("place") - 1) / TURNS).alias("segment"), "n_turns", "n_copies")
        .agg(parts.alias("parts"))
        .select("conv_id", "segment", "n_turns", "n_copies", F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("text"))
    )
