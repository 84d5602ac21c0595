"""What goes out: tables as CSV, and one rendered document for each recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoglake.functions.text import is_unknown, strip, subtitle_text
from dialoglake.functions.timecode import colon_ms_to_comma_ms, format_distance, format_time, seconds_to_time_str
from dialoglake.operators.matching import COLUMNS
from dialoglake.sources.documents import write_documents
from dialoglake.sources.storage import path_exists

#: White space at a field's ends is content, and a quote inside a field is doubled.
VERBATIM = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
TRANSCRIPT = ["start", "end", "speaker", "text", "cosine_distance"]


def transcript_rows(resolved: DataFrame) -> DataFrame:
    """Resolved segments as the transcript's strings, in order of time."""
    return resolved.select("media_id", "seq", format_time(F.col("start")).alias("start"), format_time(F.col("end")).alias("end"), "speaker", "text", format_distance(F.col("distance")).alias("cosine_distance"))


def write_transcript_csv(rows: DataFrame, path: str, recordings: DataFrame | None = None) -> None:
    """``<media_id>.csv`` for each recording, every field quoted, with a header even where there are no rows: ``recordings`` (media_id) names those without any."""
    write_documents(render_transcript_csv(rows, recordings), path, "csv", bom=True)


def write_correspondence_csv(rows: DataFrame, path: str) -> None:
    rows.repartition("media_id").sortWithinPartitions("media_id", "row_no").select("media_id", *COLUMNS).write.options(header=True, **VERBATIM).partitionBy("media_id").csv(path)


def append_metrics(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Adds ``rows`` to the table in ``path``; no rows add nothing. Columns and types are those of the first append, else it is an error.

    With a ``run`` rows lie under its name, and a run that is repeated, after a failure or by mistake, takes the place of
    itself. A table is appended to either always with runs or never.
    """
    if rows.isEmpty():
        return
    own = rows if run is None else rows.withColumn("run", F.lit(run))
    spark = rows.sparkSession
    if path_exists(path):
        there = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
        given = {f.name: f.dataType.simpleString() for f in own.schema}
        if {**there, "run": "string"} != {**given, "run": "string"} or ("run" in there) != ("run" in given):
            raise ValueError(f"the table has {there}, these rows have {given}")
    if run is None:
        own.write.mode("append").parquet(path)
    else:
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def _document(rows: DataFrame, order: str, block: Column, mark: str = "\n", good: Column | None = None, recordings: DataFrame | None = None, tail: str = "") -> DataFrame:
    """Blocks of each recording, in order, as one text, ``tail`` after the last. A recording's document is one value by nature.

    Rows that aren't ``good`` give no block; a recording without blocks, also one that ``recordings`` alone names, has an empty document.
    """
    held = F.struct(F.col(order).alias("at"), block.alias("block"))
    blocks = rows.groupBy("media_id").agg(F.array_sort(F.collect_list(held if good is None else F.when(good, held))).alias("blocks"))
    text = F.concat(F.array_join(F.col("blocks.block"), mark), F.when(F.size("blocks") > 0, tail).otherwise(""))
    return _for_each(blocks.select("media_id", text.alias("document")), recordings, "")


def _for_each(documents: DataFrame, recordings: DataFrame | None, empty: str) -> DataFrame:
    """``documents`` with an ``empty`` one for each recording that has none."""
    if recordings is None:
        return documents
    return recordings.select("media_id").distinct().join(documents, "media_id", "left").select("media_id", F.coalesce("document", F.lit(empty)).alias("document"))


def render_transcript_csv(rows: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Transcript rows -> media_id, document: the header and a line for each row, all fields quoted."""

    def line(*fields: Column) -> Column:
        return F.concat(F.lit('"'), F.concat_ws('","', *[F.replace(F.coalesce(f, F.lit("")), F.lit('"'), F.lit('""')) for f in fields]), F.lit('"\r\n'))

    head = '"' + '","'.join(TRANSCRIPT) + '"\r\n'
    body = _document(rows, "seq", line(*[F.col(c) for c in TRANSCRIPT]), "")
    return _for_each(body.select("media_id", F.concat(F.lit(head), "document").alias("document")), recordings, head)


def _srt(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), start, F.lit(" --> "), end, F.lit("\n"), text, F.lit("\n"))


def is_usable() -> Column:
    """Start, end and text are there, white space alone being content; the speaker may be blank."""
    good = F.lit(True)
    for c in ("start_time", "end_time", "subtitle_text"):
        good = good & (F.coalesce(c, F.lit("")) != "")
    return good


def usable_subtitle_rows(rows: DataFrame) -> DataFrame:
    return rows.where(is_usable())


def with_speaker_prefix(rows: DataFrame, order: str = "row_no", *keys: str) -> DataFrame:
    """Rows with ``shown``: the name before a text only where it differs from the row before; a blank row resets. ``keys`` part rows further than recordings do."""
    name = F.when(strip(F.coalesce("speaker", F.lit(""))) != "", strip(F.col("speaker")))
    before = F.lag(name).over(Window.partitionBy("media_id", *keys).orderBy(order))
    return rows.withColumn("shown", subtitle_text(name, F.col("subtitle_text"), before))


def render_subtitles(rows: DataFrame, order: str = "row_no", recordings: DataFrame | None = None) -> DataFrame:
    """Edited correspondence rows -> media_id, document: the final subtitles, empty where no row can be used."""
    marked = rows.withColumn("_good", is_usable())
    shown = with_speaker_prefix(marked, order, "_good").withColumn("_n", F.row_number().over(Window.partitionBy("media_id", "_good").orderBy(order)))
    return _document(shown, "_n", _srt(F.col("_n"), F.col("start_time"), F.col("end_time"), F.col("shown")), good=F.col("_good"), recordings=recordings)


def render_transcript_srt(rows: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Transcript rows -> ``[speaker] text`` subtitles, numbered over the rows that have start, end and text; a blank or null speaker gives the text alone."""
    bare = rows.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in ("start", "end", "speaker", "text")}).withColumn("_good", F.expr("start <> '' and end <> '' and text <> ''"))
    numbered = bare.withColumn("_n", F.row_number().over(Window.partitionBy("media_id", "_good").orderBy("seq")))
    text = F.concat(F.when(F.col("speaker") != "", F.concat(F.lit("["), F.col("speaker"), F.lit("] "))).otherwise(""), F.col("text"))
    return _document(numbered, "_n", _srt(F.col("_n"), colon_ms_to_comma_ms(F.col("start")), colon_ms_to_comma_ms(F.col("end")), text), good=F.col("_good"), recordings=recordings)


def render_clip_srt(entries: DataFrame) -> DataFrame:
    """Clip entries -> subtitles with their raw text, or with speakers (no sounds) and body put together again."""
    marks = F.array_join(F.transform("speakers", lambda x: F.concat(F.lit("（"), x, F.lit("）"))), "")
    text = F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.concat(marks, F.coalesce("body", F.lit(""))))
    return _document(entries, "index", _srt(F.col("index"), seconds_to_time_str(F.col("start")), seconds_to_time_str(F.col("end")), text))


def render_rttm(turns: DataFrame, clusters: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Turns -> RTTM with resolved names, the cluster id where there is none; every line ends."""
    met = turns.join(clusters.select("media_id", "cluster_id", "speaker"), ["media_id", "cluster_id"], "left")
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("media_id").cast("string"), F.col("start"), F.col("end") - F.col("start"), F.coalesce("speaker", "cluster_id"))
    return _document(met, "track_seq", line, tail="\n", recordings=recordings)


def recording_document(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """media_id, document: segments, representative bounds of each cluster and the number of speakers, as JSON."""
    s = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text", "cluster_id"))).alias("s"))
    s = s.select("media_id", F.transform("s", lambda x: F.struct(x["start"], x["end"], x["text"], x["cluster_id"])).alias("segments"))
    c = clusters.groupBy("media_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster_id", F.struct(F.col("rep_start").alias("start"), F.col("rep_end").alias("end")))))).alias("clusters"))
    met = s.join(c, "media_id", "full")
    return met.select("media_id", F.to_json(F.struct(F.coalesce("segments", F.array()).alias("segments"), "clusters", F.coalesce(F.size("clusters"), F.lit(0)).alias("num_speakers"))).alias("document"))


def unknown_cluster_manifest(clusters: DataFrame, representatives: DataFrame) -> DataFrame:
    """Clusters still unknown that have a representative segment, with the clip to listen to."""
    open_ = clusters.where(F.col("speaker").startswith("Unknown_") & is_unknown(F.col("speaker"))).join(representatives, ["media_id", "cluster_id"])
    return open_.select("media_id", "cluster_id", F.col("speaker").alias("label"), "distance", "candidates", F.concat(F.lit("clip_"), "cluster_id", F.lit(".wav")).alias("clip"), F.col("rep_start").alias("start"), F.col("rep_end").alias("end"))
