"""Generated subtitles against reference ones."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoglake.functions.scans import by_place, scan
from dialoglake.functions.text import is_unknown, match_key, strip
from dialoglake.operators.stats import clip_variables, first_speaker, is_speech, overlap_time_ratio

MIN_SIMILARITY, TOLERANCE = 0.6, 0.5


def fill_omitted_speakers(entries: DataFrame) -> DataFrame:
    """Speech entries with ``speaker``: a blank one takes over the last named; leading blanks stay ''."""
    speech = entries.where(is_speech()).withColumn("speaker", first_speaker())
    own = F.when(F.col("speaker") != "", F.col("speaker"))
    speech = scan(speech, by_place("entry_no"), [F.col("entry_no")], {"_before": ("last", own)})
    return speech.withColumn("speaker", F.coalesce(own, "_before", F.lit(""))).drop("_before")


def pair_keys(ours: list[str], theirs: list[str], least: float) -> list[tuple[int | None, int | None]]:
    """Order-keeping pairs of two lists of texts: equal runs first, then in each gap the most alike that comes next, later of equals.

    Runs are found over all texts; the likeness of two texts leaves out characters that are frequent in a long second one,
    as ``difflib`` does unless told otherwise. Two cheap upper bounds spare most of the full ratios.
    """
    out: list[tuple[int | None, int | None]] = []
    likeness = {}
    for tag, i0, i1, j0, j1 in difflib.SequenceMatcher(a=ours, b=theirs, autojunk=False).get_opcodes():
        if tag == "equal":
            out += zip(range(i0, i1), range(j0, j1), strict=True)
            continue
        at, used = j0, set()
        for i in range(i0, i1):
            best, found = least, None
            for j in range(at, j1):
                if (pair := likeness.get(theirs[j])) is None:
                    pair = likeness[theirs[j]] = difflib.SequenceMatcher(b=theirs[j])
                pair.set_seq1(ours[i])
                if pair.real_quick_ratio() >= best and pair.quick_ratio() >= best and (ratio := pair.ratio()) >= best:
                    best, found = ratio, j
            out.append((i, found))
            if found is not None:
                used.add(found)
                at = found + 1
        out += [(None, j) for j in range(j0, j1) if j not in used]
    return out


def align_entries(reference: DataFrame, generated: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """Both: media_id, entry_no, body. -> media_id, pair_no, gt_no, app_no (either may be null)."""
    kind = reference.schema["media_id"].dataType.simpleString()

    def run(key: tuple, gt: pd.DataFrame, app: pd.DataFrame) -> pd.DataFrame:
        gt, app = gt.sort_values("entry_no"), app.sort_values("entry_no")
        pairs = pair_keys(gt["key"].tolist(), app["key"].tolist(), least)
        g, a = gt["entry_no"].tolist(), app["entry_no"].tolist()
        return pd.DataFrame({"media_id": [key[0]] * len(pairs), "pair_no": range(1, len(pairs) + 1), "gt_no": pd.array([None if i is None else g[i] for i, _ in pairs], "Int32"), "app_no": pd.array([None if j is None else a[j] for _, j in pairs], "Int32")})

    a, b = (d.select("media_id", "entry_no", match_key(F.coalesce("body", F.lit(""))).alias("key")) for d in (reference, generated))
    return a.groupBy("media_id").cogroup(b.groupBy("media_id")).applyInPandas(run, f"media_id {kind}, pair_no int, gt_no int, app_no int")


def with_registration(rows: DataFrame, registered: DataFrame | None, speaker: str = "gt_speaker") -> DataFrame:
    """Rows with ``registered``; without a list, or with an empty one, everybody is."""
    if registered is None:
        return rows.withColumn("registered", F.lit(True))
    names = registered.select(F.col("speaker").alias(speaker), F.lit(True).alias("_in")).distinct()
    anyone = F.broadcast(registered.select(F.count("*").alias("_n")))  # one row: whether there is a list at all
    met = rows.join(names, speaker, "left").join(anyone)
    return met.withColumn("registered", F.coalesce("_in", F.lit(False)) | (F.col("_n") == 0)).drop("_in", "_n")


def judge(gt: str = "gt_speaker", app: str = "app_speaker"):
    """correct, false_negative, correct_unknown or false_positive."""
    return F.when(F.col(gt) == F.col(app), "correct").when(is_unknown(F.col(app)), F.when(F.col("registered"), "false_negative").otherwise("correct_unknown")).otherwise("false_positive")


def judged_pairs(pairs: DataFrame, reference: DataFrame, generated: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Matched pairs with both speakers, the in-point error and the judgement."""
    a = reference.select("media_id", F.col("entry_no").alias("gt_no"), F.col("start").alias("gt_start"), F.col("speaker").alias("gt_speaker"), F.col("body").alias("gt_body"))
    b = generated.select("media_id", F.col("entry_no").alias("app_no"), F.col("start").alias("app_start"), F.col("speaker").alias("app_speaker"), F.col("body").alias("app_body"))
    met = pairs.where("gt_no is not null and app_no is not null").join(a, ["media_id", "gt_no"]).join(b, ["media_id", "app_no"])
    met = with_registration(met.withColumn("error", F.abs(F.col("gt_start") - F.col("app_start"))), registered)
    return met.withColumn("judgement", judge())


def evaluation_summary(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """One row for each recording; zeros where nothing matched."""
    sides = pairs.groupBy("media_id").agg(
        F.sum((F.col("gt_no").isNotNull() & F.col("app_no").isNotNull()).cast("long")).alias("matched_count"), F.sum(F.col("app_no").isNull().cast("long")).alias("unmatched_gt_count"), F.sum(F.col("gt_no").isNull().cast("long")).alias("unmatched_app_count")
    )

    def count(name: str):
        return F.sum((F.col("judgement") == name).cast("long")).alias(f"{name}_count")

    found = judged.groupBy("media_id").agg(F.avg("error").alias("in_point_mean_error"), F.percentile("error", 0.5).alias("in_point_median_error"), F.max("error").alias("in_point_max_error"), *[count(n) for n in ("correct", "false_negative", "false_positive", "correct_unknown")])
    out = sides.join(found, "media_id", "left").fillna(0)
    return out.withColumn("speaker_accuracy", F.when(F.col("matched_count") > 0, F.col("correct_count") / F.col("matched_count")).otherwise(0.0))


def in_point_accuracy(judged: DataFrame, tolerances: tuple[float, ...] = (TOLERANCE,)) -> DataFrame:
    """media_id, tolerance, hits, accuracy: errors up to and with each tolerance."""
    each = judged.withColumn("tolerance", F.explode(F.array(*[F.lit(float(t)) for t in tolerances])))
    return each.groupBy("media_id", "tolerance").agg(F.sum((F.col("error") <= F.col("tolerance")).cast("long")).alias("hits"), F.avg((F.col("error") <= F.col("tolerance")).cast("double")).alias("accuracy"))


def confusion(judged: DataFrame) -> DataFrame:
    """Pairs of speakers with their number and ``rank``: most first, then by name."""
    counted = judged.groupBy("media_id", "gt_speaker", "app_speaker").agg(F.count("*").alias("count"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("count"), "gt_speaker", "app_speaker")))


def appearing_speakers(reference: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """media_id, speakers, registered_speaker_count, unregistered_speaker_count."""
    names = reference.where(is_speech()).select("media_id", F.explode("speakers").alias("gt_speaker")).where(strip(F.col("gt_speaker")) != "").distinct()
    known = with_registration(names, registered)
    return known.groupBy("media_id").agg(F.sort_array(F.collect_list("gt_speaker")).alias("speakers"), F.sum(F.col("registered").cast("long")).alias("registered_speaker_count"), F.sum((~F.col("registered")).cast("long")).alias("unregistered_speaker_count"))


def evaluation_report(summary: DataFrame, accuracy: DataFrame, speakers: DataFrame, reference: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One report row for each recording; the overlap ratio stays null without turns."""
    speech = reference.where(is_speech())
    durations = reference.select("media_id").distinct().join(speech.groupBy("media_id").agg(F.max("end").alias("duration")), "media_id", "left").fillna(0.0, ["duration"])
    wide = accuracy.groupBy("media_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tolerance", F.round("accuracy", 4))))).alias("in_point_accuracies"))
    out = summary.join(wide, "media_id", "left").join(speakers.drop("speakers"), "media_id", "left").join(clip_variables(reference, ["media_id"], durations), "media_id", "left")
    if turns is None:
        out = out.withColumn("overlap_time_ratio", F.lit(None).cast("double"))
    else:
        out = out.join(overlap_time_ratio(turns).select("media_id", F.round("overlap_time_ratio", 4).alias("overlap_time_ratio")), "media_id", "left")
    for c, digits in (("in_point_mean_error", 3), ("in_point_median_error", 3), ("in_point_max_error", 3), ("speaker_accuracy", 4)):
        out = out.withColumn(c, F.round(c, digits))
    return out


def evaluation_detail(judged: DataFrame) -> DataFrame:
    one_line = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" "))
    return judged.select("media_id", "pair_no", "gt_no", "app_no", "gt_start", "app_start", F.round("error", 3).alias("error"), "gt_speaker", "app_speaker", "judgement", one_line("gt_body").alias("gt_text"), one_line("app_body").alias("app_text"))
