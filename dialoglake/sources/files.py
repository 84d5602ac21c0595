"""Readers for the files that speech tools exchange. Each takes paths that Spark can read and keys rows by ``media_id``."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoglake.functions.ranks import number_in_ranges
from dialoglake.functions.text import LabelRules, is_meaningful, split_labels, strip
from dialoglake.functions.timecode import time_str_to_seconds
from dialoglake.sources.blocks import SPLIT_BYTES, read_blocks
from dialoglake.sources.documents import DocumentFiles

# Stock phrases that recognisers make up, the annotation that scripts carry, patterns of time ranges and script lines, and audio endings.
STOCK_PHRASES = (
    "ご視聴ありがとうございました",
    "ご視聴ありがとうございます",
    "ご清聴ありがとうございました",
    "ご清聴ありがとうございます",
    "最後までご視聴いただきありがとうございます",
    "最後までご視聴いただきありがとうございました",
    "チャンネル登録をお願いします",
    "チャンネル登録よろしくお願いします",
    "おわり",
    "END",
)
ANNOTATION = "心の声"
TIMES = r"(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*-->\s*(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})"
ASIDE, SPOKEN = r"^\s*[（(](.+)[)）]\s*$", r"^\s*([^\s:：（(][^:：]{0,30}?)\s*[:：]\s*(.+)$"
AUDIO = ("wav", "mp3", "m4a", "flac", "mp4", "mov", "ogg", "opus", "aac", "wma")
# End of the fixed values.

#: Seconds of a recording whose entries are numbered in one task.
STRETCH = 3600


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV, all strings, empty cells as '', with media_id from the file's name, or from the folder's where it says ``media_id=``."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    names = [c for c in read.columns if c != "media_id"]
    media = F.col("media_id").cast("string") if "media_id" in read.columns else stem(F.input_file_name())
    return read.select(media.alias("media_id"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿").strip('"')) for c in names])


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """media_id, text of whole files, without byte order mark and carriage returns."""
    read = spark.read.text(path, wholetext=True)
    return read.select(stem(F.input_file_name()).alias("media_id"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n").alias("text"))


def read_documents(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """media_id, document of the files that ``write_documents`` has written, empty ones too, which Spark's own readers pass over."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("documents").options(path=path if ":/" in path else os.path.abspath(path), ending=ending).load()


def parse_subtitles(texts: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """media_id, text of subtitle files -> entries ordered by start: media_id, entry_no, index, start, end, speakers, body, non_speech_labels, raw_text.

    Blocks are parted by blank lines; the first line that holds a time range counts; blocks without one are passed over.
    """
    return subtitle_entries(texts.select("media_id", F.lit(0).alias("split"), F.posexplode(F.split(strip(F.col("text")), r"\n[\s]*\n")).alias("nth", "block")), rules)


def subtitle_entries(blocks: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """media_id, split, nth, block -> entries; numbers come from counts of the splits, and of stretches of time, before."""
    rows = blocks.withColumn("lines", F.split("block", "\n")).withColumn("at", F.expr(f"array_position(transform(lines, l -> l rlike r'{TIMES}'), true)")).where("at > 0")
    line = F.element_at("lines", F.col("at").cast("int"))

    def seconds(first: int) -> Column:
        h, m, s, ms = (F.regexp_extract(line, TIMES, first + i).cast("int") for i in range(4))
        return h * 3600 + m * 60 + s + ms / 1000.0

    rest = F.filter(F.slice("lines", F.col("at").cast("int") + 1, F.size("lines")), lambda x: strip(x) != "")
    rows = rows.select("media_id", "split", "nth", seconds(1).alias("start"), seconds(5).alias("end"), F.array_join(rest, "\n").alias("raw_text"))
    rows = number_in_ranges(rows, F.col("split"), [F.col("nth")], "index")
    rows = number_in_ranges(rows, F.floor(F.col("start") / STRETCH), [F.col("start"), F.col("index")], "entry_no")
    rows = rows.withColumn("labels", split_labels(F.col("raw_text"), rules))
    return rows.select("media_id", "entry_no", "index", "start", "end", "labels.speakers", "labels.body", "labels.non_speech_labels", "raw_text")


def read_subtitles(spark: SparkSession, path: str, rules: LabelRules = LabelRules(), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Entries of subtitle files; a file of more than ``split_bytes`` is read by several tasks."""
    return subtitle_entries(read_blocks(spark, path, True, split_bytes), rules)


def parse_stt_srt(texts: DataFrame) -> DataFrame:
    """Recogniser subtitles: media_id, id (dense, from 0), start_tc, end_tc, start, end, text, stt_speaker. Needs three lines, the second with an arrow; senseless rows go."""
    return stt_lines(texts.select("media_id", F.lit(0).alias("split"), F.posexplode(F.split(strip(F.col("text")), "\n\n")).alias("nth", "block")))


def stt_lines(blocks: DataFrame) -> DataFrame:
    """media_id, split, nth, block -> recognised lines."""
    rows = blocks.withColumn("lines", F.split(strip(F.col("block")), "\n")).where((F.size("lines") >= 3) & F.contains(F.try_element_at("lines", F.lit(2)), F.lit("-->")))
    times = F.split(F.element_at("lines", 2), "-->")
    said = F.array_join(F.slice("lines", 3, F.size("lines")), " ")
    named = r"^\s*\[([^\]]*)\]\s*(.*)$"
    rows = rows.select("media_id", "split", "nth", strip(times[0]).alias("start_tc"), strip(times[1]).alias("end_tc"), F.when(said.rlike(named), F.regexp_extract(said, named, 2)).otherwise(said).alias("text"), strip(F.regexp_extract(said, named, 1)).alias("stt_speaker"))
    timed = rows.withColumn("start", time_str_to_seconds(F.col("start_tc"))).withColumn("end", time_str_to_seconds(F.col("end_tc")))
    kept = number_in_ranges(timed.where(has_content()), F.col("split"), [F.col("nth")], "id").withColumn("id", F.col("id") - 1)
    return kept.select("media_id", "id", "start_tc", "end_tc", "start", "end", "text", "stt_speaker")


def read_stt_srt(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Recognised lines of subtitle files; a file of more than ``split_bytes`` is read by several tasks."""
    return stt_lines(read_blocks(spark, path, False, split_bytes))


def has_content() -> Column:
    """Whether a recognised row lasts and means something."""
    return (F.col("end") > F.col("start")) & is_meaningful(F.col("text"))


def valid_stt(rows: DataFrame, order: str) -> DataFrame:
    """Rows that last and mean something, with id dense from 0."""
    kept = rows.where(has_content())
    return kept.withColumn("id", F.row_number().over(Window.partitionBy("media_id").orderBy(order)) - 1)


def script_dialogue(rows: DataFrame, order: str = "line") -> DataFrame:
    """Script rows (type, speaker, contents) -> dialogue only, without the annotation, id dense from 0."""
    kept = rows.where("type = 'dialogue'")
    return kept.select("media_id", (F.row_number().over(Window.partitionBy("media_id").orderBy(order)) - 1).alias("id"), "speaker", F.replace("contents", F.lit(ANNOTATION)).alias("dialogue"))


def script_from_text(texts: DataFrame) -> DataFrame:
    """Free text -> script rows: media_id, id (from 1), scene_id, type, speaker, contents."""
    rows = texts.select("media_id", F.posexplode(F.split("text", r"\n|\x0B|\f|\r|\x1C|\x1D|\x1E|\x85| | ")).alias("pos", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    line = F.col("line")
    aside, spoken = "(?U)" + ASIDE, "(?U)" + SPOKEN
    hashed, scene, named = line.startswith("#"), line.rlike(aside), line.rlike(spoken)
    rows = rows.withColumn("type", F.when(hashed | scene, "scene").otherwise("dialogue"))
    rows = rows.withColumn("speaker", F.when(~hashed & ~scene & named, strip(F.regexp_extract(line, spoken, 1))).otherwise(""))
    contents = F.when(hashed, strip(F.regexp_replace(line, "^#+", ""))).when(scene, strip(F.regexp_extract(line, aside, 1))).when(named, strip(F.regexp_extract(line, spoken, 2))).otherwise(line)
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("pos"))
    return rows.select("media_id", number.alias("id"), F.lit("").alias("scene_id"), "type", "speaker", contents.alias("contents"))


def parse_rttm(rows: DataFrame) -> DataFrame:
    """media_id, line_no, line -> turns; short and non-numeric rows go."""
    parts = F.split(strip(F.col("line")), r"\s+")
    read = rows.where(F.size(parts) >= 8).select("media_id", "line_no", F.get(parts, 3).try_cast("double").alias("start"), F.get(parts, 4).try_cast("double").alias("dur"), F.get(parts, 7).alias("cluster_id"))
    read = read.where("start is not null and dur is not null")
    return read.select("media_id", F.col("line_no").alias("track_seq"), "cluster_id", "start", (F.col("start") + F.col("dur")).alias("end"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    texts = whole_texts(spark, path)
    return parse_rttm(texts.select("media_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")))


def scan_voice_files(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows (path, length, modificationTime) laid out as <db>/<speaker>.<ending> -> db, speaker, path, size, modified, problem.

    A speaker found twice in one database is kept with problem 'duplicate', a file without a name before its ending with
    'no name'; hidden folders are passed over. ``checked_voice_files`` makes errors of these.
    """
    form = r"([^/.][^/]*)/([^/]*)\.([A-Za-z0-9]+)$"
    rows = files.where(F.lower(F.regexp_extract("path", form, 3)).isin(*AUDIO))
    rows = rows.select(F.regexp_extract("path", form, 1).alias("db"), F.regexp_extract("path", form, 2).alias("speaker"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    twice = F.count("*").over(Window.partitionBy("db", "speaker")) > 1
    return rows.withColumn("problem", F.when(F.col("speaker") == "", "no name").when(twice, "duplicate"))


def checked_voice_files(files: DataFrame) -> DataFrame:
    """The scan without problems; no file at all, a file without a name or a speaker twice in one database is an error."""
    found = scan_voice_files(files)
    counts = {r[0]: (r[1], r[2]) for r in found.groupBy("problem").agg(F.count("*"), F.min("path")).collect()}
    if not counts:
        raise ValueError(f"no audio file ({', '.join(sorted(AUDIO))})")
    for problem, (n, path) in counts.items():
        if problem:
            raise ValueError(f"{problem}: {n} voice files, the first of them {path}")
    return found.drop("problem")


def load_phrases(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """Stock phrases, and lines of ``extra`` (value) that aren't blank or comments."""
    own = spark.createDataFrame([(p,) for p in STOCK_PHRASES], "phrase string")
    if extra is None:
        return own
    more = extra.select(strip(F.col("value")).alias("phrase")).where("phrase <> '' and phrase not like '#%'")
    return own.unionByName(more).distinct()


def repair_asr_chunks(chunks: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Chunks (media_id, seq, start?, end?, text) with times: a missing start is the end before, a missing end the start.

    Recordings of ``whole`` (media_id, text) that have no chunk but a text get one row of no length.
    """
    order = Window.partitionBy("media_id").orderBy("seq")
    before = F.last(F.coalesce("end", "start"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce("start", before, F.lit(0.0))
    fixed = chunks.select("media_id", "seq", start.alias("start"), F.coalesce("end", start).alias("end"), "text")
    if whole is None:
        return fixed
    bare = whole.join(chunks.select("media_id").distinct(), "media_id", "left_anti").where(strip(F.col("text")) != "")
    return fixed.unionByName(bare.select("media_id", F.lit(0).cast(chunks.schema["seq"].dataType).alias("seq"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), "text"))
