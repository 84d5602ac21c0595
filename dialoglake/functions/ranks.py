"""Running numbers inside a recording without a task that holds the recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_in_ranges(rows: DataFrame, part: Column, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: numbers from 1 inside each media_id along ``order``, where ``part`` never falls along that order.

    A row's number is its place in its part, plus the rows of the parts before: a window over each part, and one over counts.
    """
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("media_id", "_part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("media_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("media_id", "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy("media_id", "_part").orderBy(*order)))
    return placed.join(before, ["media_id", "_part"]).withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_part", "_before", "_at")
