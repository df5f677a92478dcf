"""Chat logs: collapse of cumulative snapshots, and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Turns of a conversation that one task orders together.
BLOCK = 256


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, p, q, last): for each turn, how many turns there are up to it, and 128 bits of hash over them in order.

    A turn's hash holds its place, so the hash of a prefix is the exclusive or of its turns' hashes. Places and prefix hashes
    run within blocks of turn numbers first and over the blocks' totals then: a conversation of any length is spread out,
    and no texts are shuffled.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))  # as rendered
    slim = turns.select("conv_id", "turn", F.xxhash64(F.lit(1), role, text).alias("h"), F.xxhash64(text, F.lit(2), role).alias("g"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).alias("block"))
    slim = materialize(slim, "chat-turns")
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "h", "g")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = slim.groupBy("conv_id", "block").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(earlier), F.lit(0))).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "base")
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    placed = slim.withColumn("i", F.row_number().over(inner)).join(counts, on).withColumn("n", F.col("base") + F.col("i")).drop("_c", "_b", "base")
    keyed = materialize(placed.select("conv_id", "block", "n", F.xxhash64("n", "h", "g").alias("h"), F.xxhash64("g", "n", "h").alias("g")), "chat-placed")
    inner = Window.partitionBy("conv_id", "block").orderBy("n")
    totals = keyed.groupBy("conv_id", "block").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.count("*").alias("c"))
    whole = Window.partitionBy("conv_id")
    totals = totals.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.bit_xor("h").over(earlier), F.lit(0)).alias("bh"), F.coalesce(F.bit_xor("g").over(earlier), F.lit(0)).alias("bg"), F.sum("c").over(whole).alias("total"))
    run = keyed.select("conv_id", "block", "n", F.bit_xor("h").over(inner).alias("h"), F.bit_xor("g").over(inner).alias("g")).join(totals, on)
    return run.select("conv_id", "n", F.col("h").bitwiseXOR(F.col("bh")).alias("p"), F.col("g").bitwiseXOR(F.col("bg")).alias("q"), (F.col("n") == F.col("total")).alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of each conversation that is no prefix of a longer one; of equal ones the least id (null is the least)."""
    runs = materialize(prefixes(turns), "chat-prefixes")
    ends = runs.where("last").groupBy("n", "p", "q").agg(F.min(F.struct("conv_id")).alias("c"))
    return ends.join(runs.where("not last").select("n", "p", "q").distinct(), ["n", "p", "q"], "left_anti").select("c.conv_id")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, rendered): the turns of maximal conversations, each as `<|role|>`, a line break, text, a line break.

    Turns follow by number; turns of one number, by hash. Rows that repeat are turns of their own. Null texts are
    empty, null roles `unknown`, for the comparison of conversations as well. A row for a turn, so that a long conversation needs no large row; concatenated in order of
    turn they are the conversation. Null conv_ids are one conversation. An empty table gives no rows.
    """
    keep = maximal(turns).select(F.col("conv_id").alias("_c"))
    text = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return turns.select("conv_id", "turn", "role", text.alias("rendered")).join(keep, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
