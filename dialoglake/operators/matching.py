"""Scripts against recognised speech: n-grams, nearest neighbours, the best chain and the correspondence table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoglake.functions.scans import by_place, by_time, number, scan
from dialoglake.functions.text import length_weight, normalize_text
from dialoglake.functions.timecode import seconds_to_time_str, time_str_to_seconds
from dialoglake.sources.storage import kept

MAX_N, TOP_K, DIM = 3, 10, 256
#: Where lines stand that no match follows.
LAST = 2**31 - 1
# The header of the correspondence table.
COLUMNS = ["type", "script_start_id", "script_end_id", "script_speaker", "script_dialogue", "stt_start_id", "stt_end_id", "stt_speaker", "stt_text", "start_time", "end_time", "speaker", "subtitle_text"]
# End of the fixed values.


def ngrams(rows: DataFrame, text: str, max_n: int = MAX_N, by_speaker: bool = False, timed: bool = False) -> DataFrame:
    """1 to ``max_n`` consecutive lines of a recording, joined by a space; never across speakers if ``by_speaker``.

    -> media_id, ngram_id (dense, by n and start), n, start_index, end_index, original_ids, text, normalized_text, speaker?, start_time?, end_time?
    """
    along = Window.partitionBy("media_id").orderBy("id")
    cols = [F.col("id"), F.col(text).alias("text")] + ([F.col("speaker")] if by_speaker else []) + ([F.col("start"), F.col("end")] if timed else [])
    placed = rows.withColumn("start_index", F.row_number().over(along) - 1)
    reach = along.rowsBetween(0, max_n - 1) if max_n > 0 else along.rowsBetween(0, 0)
    held = placed.select("media_id", "start_index", F.collect_list(F.struct(*cols)).over(reach).alias("lines"))
    each = held.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size("lines"), F.lit(max_n))))) if max_n > 0 else held.withColumn("n", F.lit(1)).limit(0)
    each = each.withColumn("lines", F.slice("lines", F.lit(1), F.col("n")))
    if by_speaker:
        each = each.where(F.size(F.array_distinct(F.col("lines.speaker"))) == 1)
    joined = F.array_join(F.col("lines.text"), " ")
    out = each.select(
        "media_id", (F.row_number().over(Window.partitionBy("media_id").orderBy("n", "start_index")) - 1).alias("ngram_id"), "n", "start_index", (F.col("start_index") + F.col("n") - 1).alias("end_index"), F.col("lines.id").alias("original_ids"), joined.alias("text"), normalize_text(joined).alias("normalized_text"),
        *([F.element_at("lines", 1)["speaker"].alias("speaker")] if by_speaker else []),
        *([F.element_at("lines", 1)["start"].alias("start_time"), F.element_at("lines", -1)["end"].alias("end_time")] if timed else []),
    )
    return out


def hashed_trigrams(texts: list[str]) -> np.ndarray:
    """The default encoder, offline: counts of hashed character 1- to 3-grams. All texts of a batch are hashed at once."""
    sizes = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
    row, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    out = np.zeros(len(texts) * DIM)
    for n in (1, 2, 3):
        whole = np.flatnonzero(left >= n)  # places with n characters of the same text ahead
        h = np.zeros(len(whole), "i8")
        for k in range(n):
            h = (h * 1_000_003 + flat[whole + k] + n) & 0x7FFFFFFF
        out += np.bincount(row[whole] * DIM + h % DIM, minlength=len(out))
    return out.reshape(len(texts), DIM)


def encode_texts(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_trigrams, text: str = "normalized_text") -> DataFrame:
    """``rows`` with ``vec``: the encoder's vectors at unit length; a zero vector stays zero."""
    names = rows.columns

    def run(frames):
        for frame in frames:
            if len(frame):
                v = np.asarray(encoder(list(frame[text])), "f8")
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield frame[names].assign(vec=list(v / np.where(norm > 0, norm, 1)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", vec array<double>"
    return rows.mapInPandas(run, schema)


def knn_join(queries: DataFrame, index: DataFrame, k: int = TOP_K, block: int = 2048) -> DataFrame:
    """Exact inner-product neighbours inside each recording. Both: media_id, ngram_id, vec. -> media_id, script_ngram_id, stt_ngram_id, rank, similarity.

    A recording's queries and index rows are cut into blocks by their number; every pair of blocks is one tile of at most
    ``block`` by ``block`` products that keeps its k best a query, and lists are merged by query. Ties go to the smaller id.
    """
    kind = queries.schema["media_id"].dataType.simpleString()

    def top(_, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("ngram_id")
        ids, sims = x["ngram_id"].to_numpy(), np.stack(q["vec"].to_list()) @ np.stack(x["vec"].to_list()).T
        keys, n = -np.round(sims, 12), min(k, len(ids))
        if len(ids) > 4 * n:  # the n best and all that tie with the last of them
            bar = np.partition(keys, n - 1, axis=1)[:, n - 1]
            order = np.stack([(near := np.flatnonzero(row <= b))[np.argsort(row[near], kind="stable")[:n]] for row, b in zip(keys, bar, strict=True)])
        else:
            order = np.argsort(keys, axis=1, kind="stable")[:, :n]
        return pd.DataFrame({"media_id": np.repeat(q["media_id"].to_numpy(), n), "script_ngram_id": np.repeat(q["ngram_id"].to_numpy(), n), "stt_ngram_id": ids[order].ravel(), "similarity": np.take_along_axis(sims, order, 1).ravel()})

    def blocks(df: DataFrame, own: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c) for c in ("media_id", "ngram_id", "vec")], F.floor(F.col("ngram_id") / block).alias(own))

    def meet(df: DataFrame, own: str, others: DataFrame, other: str) -> DataFrame:
        numbers = others.groupBy("media_id").agg(F.collect_set(other).alias("_met"))
        return df.join(numbers, "media_id").select("*", F.explode("_met").alias(other)).drop("_met")

    q, x, key = blocks(queries, "qb"), blocks(index, "xb"), ["media_id", "qb", "xb"]
    tiles = meet(q, "qb", x, "xb").groupBy(*key).cogroup(meet(x, "xb", q, "qb").groupBy(*key))
    found = tiles.applyInPandas(top, f"media_id {kind}, script_ngram_id long, stt_ngram_id long, similarity double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("similarity", 12)).alias("less"), "stt_ngram_id", "similarity"))), 1, k)
    lists = found.groupBy("media_id", "script_ngram_id").agg(best.alias("best"))
    return lists.select("media_id", "script_ngram_id", F.posexplode("best").alias("rank", "hit")).select("media_id", "script_ngram_id", "hit.stt_ngram_id", "rank", "hit.similarity")


def candidate_pairs(neighbours: DataFrame, script: DataFrame, stt: DataFrame) -> DataFrame:
    """Neighbours with the ranges of both n-grams and the weighted similarity."""
    a = script.select("media_id", F.col("ngram_id").alias("script_ngram_id"), F.col("n").alias("script_n"), F.col("start_index").alias("script_start"), F.col("end_index").alias("script_end"))
    b = stt.select("media_id", F.col("ngram_id").alias("stt_ngram_id"), F.col("n").alias("stt_n"), F.col("start_index").alias("stt_start"), F.col("end_index").alias("stt_end"), "start_time", "end_time")
    met = neighbours.join(a, ["media_id", "script_ngram_id"]).join(b, ["media_id", "stt_ngram_id"])
    return met.withColumn("weighted_similarity", length_weight(F.col("similarity"), F.col("script_n")))


def matched_rows(chosen: DataFrame, script: DataFrame, stt: DataFrame, stt_lines: DataFrame) -> DataFrame:
    """Chosen pairs -> correspondence rows. Times come from the first and last recognised line; the script's speaker comes first."""
    a = script.select("media_id", F.col("ngram_id").alias("script_ngram_id"), F.col("original_ids").alias("script_ids"), F.col("text").alias("script_dialogue"), F.col("speaker").alias("script_speaker"))
    b = stt.select("media_id", F.col("ngram_id").alias("stt_ngram_id"), F.col("original_ids").alias("stt_ids"), F.col("text").alias("stt_text"))
    met = chosen.join(a, ["media_id", "script_ngram_id"]).join(b, ["media_id", "stt_ngram_id"])
    met = met.withColumn("stt_start_id", F.element_at("stt_ids", 1)).withColumn("stt_end_id", F.element_at("stt_ids", -1))
    first = stt_lines.select("media_id", F.col("id").alias("stt_start_id"), F.col("start").alias("t0"), F.col("stt_speaker"))
    last = stt_lines.select("media_id", F.col("id").alias("stt_end_id"), F.col("end").alias("t1"))
    met = met.join(first, ["media_id", "stt_start_id"]).join(last, ["media_id", "stt_end_id"])
    speaker = F.when(F.coalesce("script_speaker", F.lit("")) != "", F.col("script_speaker")).otherwise(F.col("stt_speaker"))
    return met.select(
        "media_id", F.lit("Matched").alias("type"), F.element_at("script_ids", 1).alias("script_start_id"), F.element_at("script_ids", -1).alias("script_end_id"), "script_speaker", "script_dialogue", "stt_start_id", "stt_end_id", "stt_speaker", "stt_text",
        seconds_to_time_str(F.col("t0")).alias("start_time"), seconds_to_time_str(F.col("t1")).alias("end_time"), speaker.alias("speaker"), F.col("script_dialogue").alias("subtitle_text"), "script_ids", "stt_ids", "similarity", "script_n", "stt_n",
    )


def unmatched(lines: DataFrame, matched: DataFrame, ids: str) -> DataFrame:
    """Lines that no match uses."""
    used = matched.select("media_id", F.explode(ids).alias("id")).distinct()
    return lines.join(used, ["media_id", "id"], "left_anti")


def correspondence(matched: DataFrame, script_lines: DataFrame, stt_lines: DataFrame) -> DataFrame:
    """The table of matched, unmatched recognised and unmatched script rows in reading order, with row_no.

    Timed rows go by start time, matched ones first of equals. An unused script line stands before the next matched row
    (in that order) with a larger script id; the rest come last. One window finds that row: the first row whose running
    maximum of matched script ids passes the line's id.
    """
    none_int, none = F.lit(None).cast("int"), F.lit(None).cast("string")
    heard = unmatched(stt_lines, matched, "stt_ids").select(
        "media_id", F.lit("Unmatched_STT").alias("type"), none_int.alias("script_start_id"), none_int.alias("script_end_id"), none.alias("script_speaker"), none.alias("script_dialogue"), F.col("id").alias("stt_start_id"), F.col("id").alias("stt_end_id"), "stt_speaker", F.col("text").alias("stt_text"),
        seconds_to_time_str(F.col("start")).alias("start_time"), seconds_to_time_str(F.col("end")).alias("end_time"), F.col("stt_speaker").alias("speaker"), F.col("text").alias("subtitle_text"),
    )
    timed = matched.select("media_id", *COLUMNS).unionByName(heard)
    timed = timed.withColumn("_at", time_str_to_seconds(F.col("start_time")))
    order = [F.col("_at"), F.when(F.col("type") == "Matched", 0).otherwise(1), F.col("stt_start_id"), F.col("script_start_id")]
    timed = kept(number(kept(timed), by_time("_at"), order, "pos").drop("_at"))
    unused = unmatched(script_lines, matched, "script_ids").select(
        "media_id", F.lit("Unmatched_Script").alias("type"), F.col("id").alias("script_start_id"), F.col("id").alias("script_end_id"), F.col("speaker").alias("script_speaker"), F.col("dialogue").alias("script_dialogue"), none_int.alias("stt_start_id"), none_int.alias("stt_end_id"), none.alias("stt_speaker"), none.alias("stt_text"),
        none.alias("start_time"), none.alias("end_time"), "speaker", F.col("dialogue").alias("subtitle_text"),
    )
    matches = timed.where("type = 'Matched'").select("media_id", "pos", "script_start_id")
    records = scan(matches, by_place("pos"), [F.col("pos")], {"before": ("max", F.col("script_start_id"))}).where("before is null or script_start_id > before")
    marks = records.select("media_id", F.col("script_start_id").alias("at"), F.lit(1).alias("kind"), "pos", none_int.alias("sid"))
    asks = unused.select("media_id", (F.col("script_start_id")).alias("at"), F.lit(2).alias("kind"), none_int.alias("pos"), F.col("script_start_id").alias("sid"))
    line = scan(asks.unionByName(marks), by_place("at"), [F.col("at"), -F.col("kind")], {"pos": ("last", F.col("pos"))}, back=True)
    placed = line.where("kind = 2").select("media_id", F.col("sid").alias("script_start_id"), F.coalesce("pos", F.lit(LAST)).alias("pos"))
    whole = kept(timed.withColumn("part", F.lit(1)).unionByName(unused.join(placed, ["media_id", "script_start_id"]).withColumn("part", F.lit(0))))
    # All lines behind the last match share one place, so there their own numbers part them.
    line = F.when(F.col("part") == 0, F.col("script_start_id"))
    part = F.struct(by_place("pos"), F.when(F.col("pos") == LAST, by_place("script_start_id")).otherwise(0))
    return fill_unmatched_times(number(whole, part, [F.col("pos"), F.col("part"), line], "row_no").drop("pos", "part"))


def fill_unmatched_times(rows: DataFrame) -> DataFrame:
    """Runs of untimed rows share the gap between their neighbours evenly; no gap gives them no length."""
    timed, part, along = F.col("type") != "Unmatched_Script", by_place("row_no"), [F.col("row_no")]
    before = F.when(timed, time_str_to_seconds(F.coalesce("end_time", "start_time")))
    after = F.when(timed, time_str_to_seconds(F.col("start_time")))
    rows = scan(rows, part, along, {"_run": ("sum", timed.cast("int")), "_a": ("last", before), "_b": ("next", after)})
    run = Window.partitionBy("media_id", "_run", timed)
    rows = rows.withColumn("_a", F.coalesce("_a", F.lit(0.0))).withColumn("_b", F.coalesce("_b", "_a"))
    rows = rows.withColumn("_k", F.row_number().over(run.orderBy("row_no"))).withColumn("_size", F.count("*").over(run))
    rows = rows.withColumn("_chunk", (F.col("_b") - F.col("_a")) / F.col("_size"))
    # A running sum along the run: chunks are added one by one, as floats round.
    step = F.when(F.col("_k") == 1, F.col("_a")).otherwise(F.col("_chunk"))
    rows = rows.withColumn("_at", F.sum(step).over(run.orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    gap = F.col("_b") > F.col("_a")
    start = F.when(gap, F.col("_at")).otherwise(F.col("_a"))
    end = F.when(gap & (F.col("_k") < F.col("_size")), F.col("_at") + F.col("_chunk")).otherwise(F.col("_b"))
    filled = rows.withColumn("start_time", F.when(timed, F.col("start_time")).otherwise(seconds_to_time_str(start)))
    filled = filled.withColumn("end_time", F.when(timed, F.col("end_time")).otherwise(seconds_to_time_str(end)))
    return filled.select("media_id", "row_no", *COLUMNS)


def usage_stats(matched: DataFrame, script_lines: DataFrame, stt_lines: DataFrame) -> DataFrame:
    """media_id, matches, script_used, script_total, script_percent, stt_used, stt_total, stt_percent."""

    def used(ids: str, name: str) -> DataFrame:
        return matched.select("media_id", F.explode(ids).alias("id")).distinct().groupBy("media_id").agg(F.count("*").alias(name))

    out = script_lines.groupBy("media_id").agg(F.count("*").alias("script_total"))
    out = out.join(stt_lines.groupBy("media_id").agg(F.count("*").alias("stt_total")), "media_id", "full")
    for part in (matched.groupBy("media_id").agg(F.count("*").alias("matches")), used("script_ids", "script_used"), used("stt_ids", "stt_used")):
        out = out.join(part, "media_id", "left")
    out = out.fillna(0, ["script_total", "stt_total", "matches", "script_used", "stt_used"])
    for side in ("script", "stt"):
        out = out.withColumn(f"{side}_percent", F.when(F.col(f"{side}_total") > 0, F.col(f"{side}_used") / F.col(f"{side}_total") * 100).otherwise(0.0))
    return out.select("media_id", "matches", "script_used", "script_total", "script_percent", "stt_used", "stt_total", "stt_percent")
