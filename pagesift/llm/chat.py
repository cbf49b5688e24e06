"""Chat formatting after collapsing the cumulative snapshots of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.materialize import materialize

# The marks of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, n_turns, text`` of the maximal conversations.

    A conversation that is the beginning of a longer one, or equal to one with a smaller id, is a
    snapshot of it and goes. Each turn carries a rolling hash (128 bits) of the turns up to it; a
    conversation goes if its last hash is the hash of a longer one's prefix. Hashes are combined and joined
    without the texts, so a first turn that very many share is one row; only the texts of what stays are gathered, one conversation per row.

    Turns are ordered by (turn, hash of role and text); a repeated turn counts once. A null role or text is empty; a null
    turn number comes first. Rows without a conversation id belong to none and are left out. Marks of the template
    inside a text are broken up by a blank. Other columns are not looked at. No rows give no rows.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    rows = rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "text", "role"))
    slim = rows.select("conv_id", "turn", "h1", "h2").distinct()
    own = W.partitionBy("conv_id").orderBy("turn", "h1", "h2")
    at = slim.withColumn("n", F.row_number().over(own)).withColumn("turns", F.count("*").over(W.partitionBy("conv_id")))
    rolling = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    prefix = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "n", "h1", "h2")).over(rolling)
    prefixes = materialize(at.select("conv_id", "n", "turns", prefix(2).alias("p1"), prefix(3).alias("p2")), "turn-prefixes")

    whole = prefixes.filter("n = turns").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    parts = prefixes.filter("n < turns").select("n", "p1", "p2").distinct()
    kept = materialize(whole.join(parts, ["n", "p1", "p2"], "left_anti").select("conv_id"), "maximal")

    broken = F.regexp_replace("text", r"<\|(im_start|im_end)\|>", "< |$1|>")
    one = F.struct("turn", "h1", "h2", F.concat(F.lit(OPEN), "role", F.lit("\n"), broken, F.lit(CLOSE + "\n")).alias("part"))
    chats = rows.join(kept, "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_set(one)).alias("parts"))
    return chats.select("conv_id", F.size("parts").cast("long").alias("n_turns"), F.array_join(F.col("parts.part"), "").alias("text"))
