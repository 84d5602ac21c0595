"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; set here only where it is unset and all runs on one machine."""
    context = spark.sparkContext
    if not (found := context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")):
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, a lost executor costs no rework.

    Columnar, so later steps read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for steps whose work isn't told by their bytes: given to ``repartition`` it isn't merged."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null, without Python."""
    return F.coalesce(F.size(F.filter(F.split(text, GAP), lambda w: w != F.lit(""))), F.lit(0)).cast("long")


def text_key(*columns: Column) -> Column:
    """128 bits that stand for the given columns' values, nulls included."""
    held = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns] + [c.isNull() for c in columns]
    return F.struct(F.xxhash64(F.lit("a"), *held).alias("a"), F.xxhash64(F.lit("b"), *held).alias("b"))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], rows: str, limit: int) -> DataFrame:
    """Left join of ``left`` with ``right``, which holds each key once and in column ``rows`` the number of left rows with it.

    Keys with more than ``limit`` rows are joined by broadcast, so that no task gathers them: there are at most
    (rows of left) / ``limit`` of them. All others meet in a shuffle join.
    """
    heavy = F.broadcast(right.where(F.col(rows) > limit))
    light = right.where(F.col(rows) <= limit)
    return left.join(heavy, keys, "inner").unionByName(left.join(F.broadcast(right.where(F.col(rows) > limit).select(*keys)), keys, "left_anti").join(light, keys, "left"))


def one_row_each(docs: DataFrame, names: list[str], chosen: DataFrame, *more: str) -> DataFrame:
    """``names`` of one row for each key of ``chosen`` (key_a, key_b: the ``text_key`` of all ``names``; rows: how often it occurs), and its columns ``more``.

    Equal rows stand for one another. Only keys that occur more than once are grouped, with a map-side first.
    """
    key = text_key(*[F.col(n) for n in names])
    keyed = docs.select(*names, key.alias("_key")).select(*names, F.col("_key.a").alias("_a"), F.col("_key.b").alias("_b"))
    met = (F.col("_a") == F.col("key_a")) & (F.col("_b") == F.col("key_b"))
    single = keyed.join(chosen.where("rows = 1"), met).select(*names, *more)
    several = keyed.join(chosen.where("rows > 1"), met).groupBy("_a", "_b").agg(F.first(F.struct(*names)).alias("row"), *[F.first(m).alias(m) for m in more])
    return single.unionByName(several.select("row.*", *more))
