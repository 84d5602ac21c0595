"""Chat formatting after collapsing cumulative snapshots.

A log often holds a conversation several times, each time a few turns longer. Every turn gets a hash of its position, role
and text; running sums of these hashes along a conversation stand for its prefixes. A conversation whose full sum is a
proper prefix's sum of a longer one is a snapshot and goes, by anti-join; of equal conversations the smallest id stays.
The rest is rendered. DataFrame functions only.

Sums run over four 32-bit parts of two independent 64-bit hashes, so unequal prefixes meet with odds of about 2^-128.

Defined results: repeated rows (same id, turn, role, text) count once; turns are ordered by number, null first, then role
and text; a null text or role renders as empty but differs from an empty one; turns without a conversation id are
conversations of one turn each; markers inside a text are broken up, and in a role their characters and line breaks become
spaces; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoglake.llm.common import settle

PARTS = ["h1", "h2", "h3", "h4"]


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> the same with own (a key per conversation) and a, b: two hashes of role and text."""
    once = turns.select("conv_id", "turn", "role", "text").withColumn("turn", F.when(F.col("conv_id").isNotNull(), F.col("turn")))
    lone = F.concat(F.lit("-"), F.sha2(F.to_json(F.struct("role", "text")), 256))
    held = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("role").isNull(), F.col("text").isNull()]
    own = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), lone)
    return once.select(own.alias("own"), "conv_id", "turn", "role", "text", F.xxhash64(F.lit(1), *held).alias("a"), F.xxhash64(F.lit(2), *held).alias("b"))


def prefix_hashes(said: DataFrame) -> DataFrame:
    """``keyed`` turns -> own, conv_id, n, PARTS (of the prefix up to here) and last, one row for each distinct turn; texts stay where they are.

    Turns go by number, role and text. Texts are looked at only where turns agree in number and role.
    """
    hashes = settle(said.select("own", "conv_id", "turn", "role", "a", "b").distinct())
    same = ["own", "turn", "role"]
    tied = hashes.groupBy(*same).count().where("count > 1").select(*[F.col(c).alias(f"_{c}") for c in same])
    if tied.isEmpty():
        ranked = hashes.withColumn("rank", F.lit(1))
    else:
        here = (F.col("own") == F.col("_own")) & F.col("turn").eqNullSafe(F.col("_turn")) & F.col("role").eqNullSafe(F.col("_role"))
        texts = said.join(tied, here).select(*said.columns).distinct()
        by_text = texts.withColumn("rank", F.row_number().over(Window.partitionBy(*same).orderBy("text"))).drop("text")
        ranked = hashes.join(tied, here, "left_anti").withColumn("rank", F.lit(1)).unionByName(by_text)
    along = Window.partitionBy("own").orderBy("turn", "role", "rank")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranked.withColumn("n", F.row_number().over(along))
    low = F.lit(2**32 - 1).cast("long")
    h, k = F.xxhash64("n", "a"), F.xxhash64("n", "b")
    parts = [F.shiftrightunsigned(h, 32), h.bitwiseAND(low), F.shiftrightunsigned(k, 32), k.bitwiseAND(low)]
    summed = placed.withColumns({name: F.sum(part).over(so_far) for name, part in zip(PARTS, parts, strict=True)})
    return summed.select("own", "conv_id", "n", *PARTS, F.lead("n").over(along).isNull().alias("last"))


def maximal(hashed: DataFrame) -> DataFrame:
    """own keys of the conversations that are no prefix of another and the first of their equals."""
    key = ["n", *PARTS]
    whole = hashed.where("last").groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNull().alias("without"), "conv_id", "own")).alias("first"))
    inner = hashed.where("not last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select(F.col("first.own").alias("own"))


def render(said: DataFrame, chosen: DataFrame) -> DataFrame:
    """``keyed`` turns of the ``chosen`` conversations (own) -> conv_id, n_turns, chat. Texts are shuffled once, by conversation."""
    kept = said.select("own", "conv_id", "turn", "role", "text").join(chosen, "own", "left_semi")
    turns = kept.groupBy("own").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"), F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))

    def block(x: Column) -> Column:
        text = F.replace(F.coalesce(x["text"], F.lit("")), F.lit("<|"), F.lit("< |"))
        # A role stands inside a marker, so it may hold no part of one.
        role = F.translate(F.coalesce(x["role"], F.lit("")), "<|>\n\r", "     ")
        return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))

    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", block), "").alias("chat"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, chat."""
    said = keyed(turns)
    return render(said, maximal(prefix_hashes(said)))
