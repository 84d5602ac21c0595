"""Contrasting clips: candidate windows, their scores, and the pair that differs most."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoglake.functions.timecode import format_time
from dialoglake.operators.figures import EPS, window_sums
from dialoglake.operators.stats import is_speech, utterance_counts


@dataclass(frozen=True)
class ClipOptions:
    length: float = 300.0
    tolerance: float = 15.0
    weight_change: float = 1.0
    weight_overlap: float = 1.0
    target_speakers: int | None = None
    speaker_penalty: float = 0.5


def enumerate_windows(entries: DataFrame, options: ClipOptions = ClipOptions()) -> DataFrame:
    """media_id, window_no, start, end: from each speech start to the first speech end not before start + length, if near enough.

    A forward as-of join without a join: starts (moved by length) and ends are one sorted line, and the next end is a window function.
    """
    speech = entries.where(is_speech())
    asked = speech.select("media_id", (F.col("start") + options.length - EPS).alias("t"), F.lit(0).alias("kind"), "start", F.col("entry_no").alias("no"), F.lit(None).cast("double").alias("end"))
    ends = speech.select("media_id", "end").distinct().select("media_id", F.col("end").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("int").alias("no"), "end")
    # Read from the far end, so that the frame only grows: a frame that shrinks from behind costs the square of a recording.
    onward = Window.partitionBy("media_id").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(ends).withColumn("end", F.last("end", ignorenulls=True).over(onward)).where("kind = 0 and end is not null")
    near = found.where(F.abs(F.col("end") - F.col("start") - options.length) <= options.tolerance)
    return near.select("media_id", F.row_number().over(Window.partitionBy("media_id").orderBy("start", "no")).alias("window_no"), "start", "end")


def window_members(windows: DataFrame, entries: DataFrame, bin_seconds: float = 300.0) -> DataFrame:
    """Entries inside each window, sounds too: a containment join on recording and time bin."""
    w = windows.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - EPS) / bin_seconds), F.floor((F.col("end") + EPS) / bin_seconds))))
    w = w.withColumnsRenamed({"start": "w_start", "end": "w_end"})
    e = entries.withColumn("bin", F.floor(F.col("start") / bin_seconds))
    met = w.join(e, ["media_id", "bin"]).where((F.col("start") >= F.col("w_start") - EPS) & (F.col("end") <= F.col("w_end") + EPS))
    return met.drop("bin")


def window_variables(windows: DataFrame, entries: DataFrame, options: ClipOptions = ClipOptions()) -> DataFrame:
    """Windows of at most ``options``' length and tolerance with the figures of their speech; see ``figures`` for how."""
    sums = window_sums(windows, entries, options.length + options.tolerance)
    met = windows.withColumn("window_no", F.col("window_no").cast("long")).join(sums, ["media_id", "window_no"], "left").fillna(0, ["n", "two", "seconds", "changes", "speakers"])
    d = F.col("end") - F.col("start")
    return met.select(
        "media_id", F.col("window_no").cast("int").alias("window_no"), "start", "end", d.alias("duration"), F.col("n").alias("utterance_count"), F.col("speakers").alias("speaker_count"), F.col("changes").alias("speaker_change_count"),
        F.when(d > 0, F.col("changes") / (d / 60)).otherwise(0.0).alias("speaker_change_per_min"), F.col("two").alias("overlap_entry_count"), F.when(F.col("n") > 0, F.col("two") / F.col("n")).otherwise(0.0).alias("overlap_entry_ratio"),
        F.when(d > 0, F.col("seconds") / d).otherwise(0.0).alias("speech_time_ratio"),
    )


def score_windows(windows: DataFrame, options: ClipOptions = ClipOptions()) -> DataFrame:
    """Windows with score: weighted z-scores inside the recording, less a penalty for missing the number of speakers."""
    figures = {"change": "speaker_change_per_min", "overlap": "overlap_entry_ratio"}
    means = windows.groupBy("media_id").agg(F.count("*").alias("_n"), *[f(c).alias(f"_{name}_{f.__name__}") for name, c in figures.items() for f in (F.avg, F.stddev_pop, F.min, F.max)])
    met = windows.join(means, "media_id")

    def z(name: str):
        mean, spread, low, high = (F.col(f"_{name}_{f}") for f in ("avg", "stddev_pop", "min", "max"))
        return F.when((F.col("_n") < 2) | (low == high) | (spread == 0), 0.0).otherwise((F.col(figures[name]) - mean) / spread)

    score = options.weight_change * z("change") + options.weight_overlap * z("overlap")
    if options.target_speakers is not None:
        score = score - F.abs(F.col("speaker_count") - options.target_speakers) * options.speaker_penalty
    return met.select(*windows.columns, score.alias("score"))


def select_clip_pair(scored: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """media_id, status, hard and calm: of all pairs of windows apart in time the largest difference of scores, the first such pair.

    Recordings without two windows apart get 'no disjoint pair'; those of ``recordings`` (media_id) without any get 'no window'.

    A window's best partner is the highest or lowest later one that starts at its end or after: suffix extremes of the
    sorted line, read at the window's end, so no pairs are built.
    """
    line = scored.select("media_id", F.col("start").alias("t"), F.lit(1).alias("kind"), "window_no", "score", F.lit(None).cast("double").alias("own"), F.lit(None).cast("int").alias("asks"))
    asks = scored.select("media_id", (F.col("end") - EPS).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("window_no"), F.lit(None).cast("double").alias("score"), F.col("score").alias("own"), F.col("window_no").alias("asks"))
    onward = Window.partitionBy("media_id").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    real = F.col("window_no").isNotNull()
    high = F.max(F.when(real, F.struct("score", (-F.col("window_no")).alias("less")))).over(onward)
    low = F.max(F.when(real, F.struct((-F.col("score")).alias("minus"), (-F.col("window_no")).alias("less")))).over(onward)
    met = line.unionByName(asks).withColumn("high", high).withColumn("low", low).where("kind = 0 and high is not null")
    up = F.struct((F.col("high.score") - F.col("own")).alias("diff"), F.col("high.less").alias("less"))
    down = F.struct((F.col("own") + F.col("low.minus")).alias("diff"), F.col("low.less").alias("less"))
    met = met.withColumn("best", F.greatest(up, down)).where("best.less <> -asks")
    won = met.groupBy("media_id").agg(F.max(F.struct("best.diff", (-F.col("asks")).alias("i"), F.col("best.less").alias("j"))).alias("m"))
    pairs = won.select("media_id", F.col("m.diff").alias("difference"), (-F.col("m.i")).alias("i"), (-F.col("m.j")).alias("j"))
    a = scored.select("media_id", F.col("window_no").alias("i"), F.col("score").alias("si"))
    b = scored.select("media_id", F.col("window_no").alias("j"), F.col("score").alias("sj"))
    both = pairs.join(a, ["media_id", "i"]).join(b, ["media_id", "j"])
    first_hard = F.col("si") >= F.col("sj")
    chosen = both.select("media_id", F.when(first_hard, F.col("i")).otherwise(F.col("j")).alias("hard"), F.when(first_hard, F.col("j")).otherwise(F.col("i")).alias("calm"), "difference")
    every = scored.select("media_id", F.lit(True).alias("_some")).distinct()
    if recordings is not None:
        every = recordings.select("media_id").distinct().join(every, "media_id", "left")
    status = F.when(F.col("_some").isNull(), "no window").when(F.col("hard").isNull(), "no disjoint pair").otherwise("ok")
    return every.join(chosen, "media_id", "left").withColumn("status", status).drop("_some")


def shift_entries(entries: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """Times less the clip's start, not below zero, numbered from 1 again."""
    order = Window.partitionBy(*keys).orderBy("entry_no")
    moved = entries.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - F.col(offset))).withColumn("end", F.greatest(F.lit(0.0), F.col("end") - F.col(offset)))
    return moved.withColumn("index", F.row_number().over(order))


def clip_report(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row for each chosen clip: name, kind, times as text and rounded seconds, its figures."""
    chosen = pairs.where("status = 'ok'").select("media_id", F.expr("stack(2, 'hard', hard, 'calm', calm) as (kind, window_no)"))
    met = chosen.join(windows, ["media_id", "window_no"])
    name = F.concat_ws("_", F.col("media_id").cast("string"), "kind")
    return met.select("media_id", name.alias("name"), "kind", "window_no", format_time(F.col("start")).alias("start_tc"), format_time(F.col("end")).alias("end_tc"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), *[c for c in met.columns if c not in ("media_id", "kind", "window_no", "start", "end")])


def clip_utterances(clips: DataFrame, entries: DataFrame) -> DataFrame:
    """``clips`` (two of each recording at most) with utterance_counts, the only figure that needs the entries themselves."""
    keys = ["media_id", "kind"]
    inside = window_members(clips.select(*keys, "start", "end"), entries)
    return clips.join(utterance_counts(inside, keys), keys, "left")


def clip_cut_list(clips: DataFrame) -> DataFrame:
    """What a cutter needs: media_id, start and end with three decimals, file name."""
    return clips.select("media_id", F.format_string("%.3f", "start").alias("start"), F.format_string("%.3f", "end").alias("end"), F.concat("name", F.lit(".mp4")).alias("output"))


def overlap_signal_check(windows: DataFrame) -> DataFrame:
    """Recordings where no window has an entry of two speakers, so that scores rest on changes alone."""
    return windows.groupBy("media_id").agg((F.max("overlap_entry_count") == 0).alias("no_overlap_signal"))
