"""Figures of subtitle tracks: who speaks, how often it changes, how much overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoglake.functions.scans import STRETCH, by_place, scan
from dialoglake.functions.text import strip
from dialoglake.functions.timecode import is_integer_ms


def is_speech() -> Column:
    return (F.size("speakers") > 0) | (strip(F.coalesce("body", F.lit(""))) != "")


def first_speaker() -> Column:
    return F.coalesce(strip(F.get("speakers", F.lit(0))), F.lit(""))


def speaker_changes(entries: DataFrame, keys: list[str], order: str = "entry_no") -> DataFrame:
    """keys, changes: entries whose first speaker differs from the last named one before; the first named entry is no change."""
    named = entries.where(is_speech()).withColumn("_who", first_speaker()).where("_who <> ''")
    named = scan(named.select(*keys, order, "_who"), by_place(order), [F.col(order)], {"_before": ("last", F.col("_who"))}, tuple(keys))
    return named.withColumn("_changed", (F.col("_who") != F.col("_before")).cast("long")).groupBy(*keys).agg(F.coalesce(F.sum("_changed"), F.lit(0)).alias("changes"))


def utterance_counts(entries: DataFrame, keys: list[str], order: str = "entry_no") -> DataFrame:
    """keys, utterance_counts: array of (speaker, count), most first, of equals the first to appear. An entry counts for each of its speakers."""
    each = entries.where(is_speech()).select(*keys, F.col(order).alias("_at"), F.posexplode("speakers").alias("_pos", "speaker"))
    counted = each.groupBy(*keys, "speaker").agg(F.count("*").alias("count"), F.min(F.struct("_at", "_pos")).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "first", "speaker", "count")))
    return counted.groupBy(*keys).agg(F.transform(listed, lambda x: F.struct(x["speaker"], x["count"])).alias("utterance_counts"))


def clip_variables(entries: DataFrame, keys: list[str], durations: DataFrame, order: str = "entry_no") -> DataFrame:
    """``durations`` (keys, duration) with the figures of each group's speech; groups without speech get zeros."""
    speech = entries.where(is_speech())
    basic = speech.groupBy(*keys).agg(
        F.count("*").alias("utterance_count"),
        F.sum((F.size("speakers") >= 2).cast("long")).alias("overlap_entry_count"),
        F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("speech_seconds"),
    )
    counts = utterance_counts(entries, keys, order)
    out = durations.join(basic, keys, "left").join(speaker_changes(entries, keys, order), keys, "left").join(counts, keys, "left")
    zero, d = F.lit(0).cast("long"), F.col("duration")
    n, changes, double = (F.coalesce(c, zero) for c in ("utterance_count", "changes", "overlap_entry_count"))
    return out.select(
        *keys,
        "duration",
        n.alias("utterance_count"),
        F.coalesce(F.size("utterance_counts"), F.lit(0)).cast("long").alias("speaker_count"),
        changes.alias("speaker_change_count"),
        F.when(d > 0, changes / (d / 60)).otherwise(0.0).alias("speaker_change_per_min"),
        double.alias("overlap_entry_count"),
        F.when(n > 0, double / n).otherwise(0.0).alias("overlap_entry_ratio"),
        F.when(d > 0, F.coalesce("speech_seconds", F.lit(0.0)) / d).otherwise(0.0).alias("speech_time_ratio"),
        "utterance_counts",
    )


def overlap_time_ratio(turns: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """media_id, overlap_time_ratio: time with two or more turns open, over time with one or more; microseconds inside.

    A recording is scanned in stretches of time, each its own group: how many turns are open where one begins is the sum over
    those before, and its last edge lasts until the first of the next, so only one row for each stretch is gathered for a recording.
    """
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    both = F.array(F.struct(us("start").alias("t"), F.lit(1).alias("d")), F.struct(us("end").alias("t"), F.lit(-1).alias("d")))
    # A turn without length opens nothing; its one edge keeps the recording in the result.
    none = F.array(F.struct(F.coalesce(us("start"), F.lit(0).cast("long")).alias("t"), F.lit(0).alias("d")))
    edges = turns.select("media_id", F.explode(F.when(F.col("end") > F.col("start"), both).otherwise(none)).alias("e"))
    placed = edges.select("media_id", F.floor(F.col("e.t") / int(stretch * 1_000_000)).alias("part"), "e.t", "e.d").repartition("media_id", "part")
    net = placed.groupBy("media_id", "part", "t").agg(F.sum("d").alias("d"))
    parts = net.groupBy("media_id", "part").agg(F.sum("d").alias("sum"), F.min("t").alias("first"))
    along = Window.partitionBy("media_id").orderBy("part")
    ends = parts.select("media_id", "part", F.coalesce(F.sum("sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("open"), F.lead("first").over(along).alias("next"))
    inside = Window.partitionBy("media_id", "part").orderBy("t")
    held = net.withColumn("sofar", F.sum("d").over(inside)).withColumn("then", F.lead("t").over(inside)).join(ends, ["media_id", "part"])
    span, depth = F.coalesce("then", "next") - F.col("t"), F.col("open") + F.col("sofar")
    sums = held.groupBy("media_id").agg(F.sum(F.when(depth >= 2, span).otherwise(0)).alias("two"), F.sum(F.when(depth >= 1, span).otherwise(0)).alias("one"))
    return sums.select("media_id", F.when(F.col("one") > 0, F.col("two") / F.col("one")).otherwise(0.0).alias("overlap_time_ratio"))


def label_inventory(entries: DataFrame) -> DataFrame:
    """media_id with its distinct speaker and other labels, sorted, and how many of each."""
    rows = entries.select("media_id", F.explode(F.concat(F.transform("speakers", lambda x: F.struct(F.lit(True).alias("s"), x.alias("l"))), F.transform("non_speech_labels", lambda x: F.struct(F.lit(False).alias("s"), x.alias("l"))))).alias("x"))
    sets = rows.groupBy("media_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("x.s") == s, F.col("x.l")))).alias(n) for s, n in ((True, "speakers"), (False, "sounds"))])
    return sets.withColumn("speaker_labels", F.size("speakers").cast("long")).withColumn("sound_labels", F.size("sounds").cast("long"))


def ms_precision_audit(segments: DataFrame) -> DataFrame:
    """media_id, whole_ms, total: how many of the starts and ends are whole milliseconds."""
    ends = segments.select("media_id", F.explode(F.array("start", "end")).alias("t"))
    return ends.groupBy("media_id").agg(F.sum(is_integer_ms(F.col("t")).cast("long")).alias("whole_ms"), F.count("*").alias("total"))


def ms_precision_violations(segments: DataFrame) -> DataFrame:
    ends = segments.select("media_id", "seq", F.expr("stack(2, 'start', start, 'end', end) as (edge, t)"))
    return ends.where(~is_integer_ms(F.col("t")))


def utterance_count_check(transcripts: DataFrame, entries: DataFrame) -> DataFrame:
    """Non-blank lines of human transcripts (media_id, line) against speech entries: both counts, and whether they agree."""
    a = transcripts.where(strip(F.col("line")) != "").groupBy("media_id").agg(F.count("*").alias("lines"))
    b = entries.where(is_speech()).groupBy("media_id").agg(F.count("*").alias("utterances"))
    met = a.join(b, "media_id", "full").fillna(0, ["lines", "utterances"])
    return met.withColumn("same", F.col("lines") == F.col("utterances"))
