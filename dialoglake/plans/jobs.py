"""The operators put together into the library's jobs.

What several outputs of a job read is kept by ``cache()``: Spark spills it to disk and recomputes what a lost executor held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.functions.text import LabelRules
from dialoglake.operators import chains, cleaning, clips, evaluation, matching, sinks, speakers
from dialoglake.sources.embedding_store import EmbeddingStore
from dialoglake.sources.storage import kept


def build_transcripts(segments: DataFrame, turns: DataFrame, clusters: DataFrame | None, registry: DataFrame | None, phrases: DataFrame, threshold: float = 0.5, nearest: int | None = None) -> dict[str, DataFrame]:
    """Recognised segments, turns and voices -> transcript, named clusters, subtitles, RTTM and the manifest of unknown voices.

    The manifest holds the distances to the ``nearest`` names, or to all.
    """
    said = kept(cleaning.drop_hallucinations(segments, phrases))
    reps = speakers.representative_segment(turns)
    if registry is None or clusters is None:
        named = speakers.label_all_unknown(reps.select("media_id", "cluster_id")).withColumn("distance", F.lit(None).cast("double")).withColumn("candidates", F.lit(None).cast("map<string,double>"))
    else:
        voices = reps.select("media_id", "cluster_id").join(clusters, ["media_id", "cluster_id"], "left")
        named = speakers.identify(voices, registry, threshold, nearest)
    rows = speakers.resolve_speaker(speakers.dominant_cluster(said, turns), named)
    transcript = sinks.transcript_rows(rows)
    return {"segments": rows, "clusters": named, "transcript": transcript, "subtitles": sinks.render_transcript_srt(transcript), "rttm": sinks.render_rttm(turns, named), "manifest": sinks.unknown_cluster_manifest(named, reps)}


def label_and_rematch(transcript: DataFrame, clusters: DataFrame, registry: DataFrame, labelled: DataFrame, threshold: float = 0.5, recompute: bool = False) -> dict[str, DataFrame]:
    """Give names to unknown clusters, register their voices, match the others again, and rewrite rows and subtitles."""
    moved = speakers.rematch_unknowns(clusters, registry, labelled, threshold, recompute)
    rows = speakers.relabel(transcript, moved.where("how is not null").select("media_id", "old", "speaker", "distance"))
    return {"clusters": moved, "registry": speakers.with_voices(registry, speakers.new_voices(clusters, labelled)), "transcript": rows, "subtitles": sinks.render_transcript_srt(rows)}


def match_script(script_lines: DataFrame, stt_lines: DataFrame, encoder: Callable = matching.hashed_trigrams, max_n: int = matching.MAX_N, k: int = matching.TOP_K) -> dict[str, DataFrame]:
    """Script against recognised lines -> correspondence table and usage."""
    a = matching.ngrams(script_lines, "dialogue", max_n, by_speaker=True).cache()
    b = matching.ngrams(stt_lines, "text", max_n, timed=True).cache()
    near = matching.knn_join(*[matching.encode_texts(g, encoder).select("media_id", "ngram_id", "vec").cache() for g in (a, b)], k)
    chosen = chains.weighted_chain(matching.candidate_pairs(near, a, b)).cache()
    matched = matching.matched_rows(chosen, a, b, stt_lines).cache()
    return {"matched": matched, "table": matching.correspondence(matched, script_lines, stt_lines), "usage": matching.usage_stats(matched, script_lines, stt_lines)}


def export_subtitles(table: DataFrame) -> DataFrame:
    return sinks.render_subtitles(table)


def select_clips(entries: DataFrame, options: clips.ClipOptions = clips.ClipOptions()) -> dict[str, DataFrame]:
    """Subtitle tracks -> scored windows, the chosen pair of each recording, report, cut list and shifted entries."""
    windows = clips.enumerate_windows(entries, options)
    scored = clips.score_windows(clips.window_variables(windows, entries, options).cache(), options).cache()
    pairs = clips.select_clip_pair(scored, entries)
    report = clips.clip_report(pairs, scored)
    chosen = report.select("media_id", "kind", "window_no").join(scored.select("media_id", "window_no", "start", "end"), ["media_id", "window_no"])
    inside = clips.window_members(chosen, entries)
    utterances = clips.clip_utterances(chosen, entries).select("media_id", "kind", "utterance_counts")
    return {"windows": scored, "pairs": pairs, "report": report, "utterances": utterances, "cuts": clips.clip_cut_list(report), "entries": clips.shift_entries(inside, ["media_id", "kind"], "w_start")}


def evaluate_subtitles(reference: DataFrame, generated: DataFrame, registered: DataFrame | None = None, tolerances: tuple[float, ...] = (evaluation.TOLERANCE,), turns: DataFrame | None = None, rules: LabelRules = LabelRules()) -> dict[str, DataFrame]:
    """Reference and generated entries -> detail, summary, accuracy, confusion and report."""
    a, b = evaluation.fill_omitted_speakers(reference), evaluation.fill_omitted_speakers(generated)
    pairs = evaluation.align_entries(a, b).cache()
    judged = evaluation.judged_pairs(pairs, a, b, registered).cache()
    summary, accuracy = evaluation.evaluation_summary(pairs, judged), evaluation.in_point_accuracy(judged, tolerances)
    speakers_ = evaluation.appearing_speakers(reference, registered)
    return {"pairs": pairs, "detail": evaluation.evaluation_detail(judged), "summary": summary, "accuracy": accuracy, "confusion": evaluation.confusion(judged), "report": evaluation.evaluation_report(summary, accuracy, speakers_, reference, turns)}


def build_registry(files: DataFrame, cache: DataFrame, embed: Callable, complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """Voice files (namespace, db, speaker, path, content) -> registry of unit vectors, and what is new for the cache; a ``complete`` cache lacks none."""
    hits, misses = speakers.missing_embeddings(files, cache)
    new = speakers.compute_embeddings(misses, embed)
    vectors = cache if complete else cache.unionByName(new)
    named = files.withColumn("content_sha256", F.sha2("content", 256)).drop("content").join(vectors, ["namespace", "content_sha256"])
    unit = named.select("db", "speaker", speakers.l2_normalize(F.col("embedding")).alias("embedding"), F.row_number().over(matching.Window.partitionBy("db", "speaker").orderBy("path")).alias("seq"))
    empty = unit.select("db", "speaker", "embedding").limit(0)
    return speakers.upsert_voiceprints(empty, unit.where("embedding is not null")), new


def build_registry_from_store(files: DataFrame, store: EmbeddingStore, embed: Callable) -> tuple[DataFrame, int]:
    """Voice files -> registry, by way of the store: only contents that it lacks are computed, and published before they are used.

    Also tells how many were computed. A run that is lost before it publishes computes them again, one lost later doesn't.
    Files without a namespace or content give no voice.
    """
    spark, files = files.sparkSession, files.where("namespace is not null and content is not null")
    misses = speakers.missing_embeddings(files, store.read(spark))[1]
    computed = 0 if misses.isEmpty() else store.add(speakers.compute_embeddings(misses, embed))
    return build_registry(files, store.read(spark), embed, complete=True)[0], computed
