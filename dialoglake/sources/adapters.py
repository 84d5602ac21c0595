"""The library's tables out of the driver's: how conversations, events, documents and embeddings become recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, 60 ms a character: media_id, seq, speaker, start, end, text."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = table(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return said.select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), (F.col("before") * 60 / 1000.0).alias("start"), ((F.col("before") + F.length("text")) * 60 / 1000.0).alias("end"), "text"
    )


def _timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    day_ms = (F.unix_micros(F.col("ts").cast("timestamp")) % F.lit(86_400_000_000)) / 1000
    start = F.floor(day_ms)
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("media_id"), F.col("event_id"), F.col("event_type"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("cluster_id"), (start / 1000.0).alias("start"), ((start + F.round(F.col("value") * 1000)) / 1000.0).alias("end"), F.col("props").alias("text")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns out of events that are no view or click: media_id, track_seq, cluster_id, start, end."""
    rows = _timed_events(spark, sf_dir).where(~F.col("event_type").isin("view", "click"))
    return rows.select("media_id", F.col("event_id").alias("track_seq"), "cluster_id", "start", "end")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised segments out of views and clicks: media_id, seq, start, end, text."""
    rows = _timed_events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return rows.select("media_id", F.col("event_id").alias("seq"), "start", "end", "text")


def voiceprints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Registry (the first vector of each label) and clusters (all others): speaker, reg_order, embedding; media_id, cluster_id, embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    registry = vectors.join(first, ["label", "vec_id"]).select(F.format_string("speaker_%05d", "label").alias("speaker"), F.col("label").alias("reg_order"), "embedding")
    clusters = vectors.join(first, ["label", "vec_id"], "left_anti").select((F.col("vec_id") % 20).alias("media_id"), F.format_string("c%08d", "vec_id").alias("cluster_id"), "embedding")
    return registry, clusters


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: media_id, seq, text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long subtitle tracks out of events: media_id, entry_no, start, end, speakers, body."""
    order = Window.partitionBy("media_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("media_id"), "ts", "event_id", "event_type", F.col("props").alias("body"), (2000 + F.round(F.col("value") * 100)).cast("long").alias("ms"))
    rows = rows.withColumn("upto", F.sum("ms").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("entry_no", F.row_number().over(order))
    both = F.when(F.col("event_id") % 7 == 0, F.array("event_type", F.lit("guest"))).when(F.col("event_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type"))
    return rows.select("media_id", "entry_no", ((F.col("upto") - F.col("ms")) / 1000.0).alias("start"), (F.col("upto") / 1000.0).alias("end"), both.alias("speakers"), "body")


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts out of conversations: media_id, id, speaker, dialogue."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").cast("int").alias("id"), F.col("role").alias("speaker"), F.col("text").alias("dialogue"))


def stt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recogniser might hear of those scripts: every fifth turn is missed, texts lose their tails: media_id, id, start, end, text, stt_speaker."""
    heard = utterances(spark, sf_dir).where("seq % 5 <> 4")
    order = Window.partitionBy("media_id").orderBy("seq")
    return heard.select("media_id", (F.row_number().over(order) - 1).alias("id"), "start", "end", F.expr("substring(text, 1, length(text) - length(text) div 8)").alias("text"), F.lit("").alias("stt_speaker"))
