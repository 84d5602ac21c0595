"""Recognised text that a recogniser made up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.functions.scans import by_place, scan
from dialoglake.functions.text import is_short_unit_repeated, normalize_for_repeat, strip


def mark_hallucinations(rows: DataFrame, phrases: DataFrame, normalize=normalize_for_repeat) -> DataFrame:
    """media_id, seq, text, ... -> the rows with ``norm`` and ``reason``: blank, phrase, repeat, duplicate, or null for what stays.

    A row is a duplicate if it says what the last accepted row said. Once the other kinds are out, that is what the last row
    left over said, so a scan does. A text that is nothing once normalised stays and isn't remembered.
    """
    known = phrases.select(normalize(F.col("phrase")).alias("norm")).distinct().withColumn("_known", F.lit(True))
    seen = rows.withColumn("norm", normalize(F.coalesce("text", F.lit("")))).join(known, "norm", "left")
    reason = F.when(strip(F.coalesce("text", F.lit(""))) == "", "blank").when(F.col("norm") == "", F.lit(None)).when(F.col("_known"), "phrase").when(is_short_unit_repeated(F.col("norm")), "repeat")
    seen = seen.withColumn("reason", reason).drop("_known")
    live = F.col("reason").isNull() & (F.col("norm") != "")
    seen = scan(seen, by_place("seq"), [F.col("seq")], {"_before": ("last", F.when(live, F.col("norm")))})
    return seen.withColumn("reason", F.when(live & (F.col("norm") == F.col("_before")), "duplicate").otherwise(F.col("reason"))).drop("_before")


def drop_hallucinations(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    return mark_hallucinations(rows, phrases).where("reason is null").select(*rows.columns)
