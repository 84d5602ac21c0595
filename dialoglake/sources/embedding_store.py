"""Vectors of voice files that are kept between runs, by namespace (a model and its settings) and content."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglake.sources.storage import place

#: The leading hex digits of a content's hash that name a folder.
PREFIX = 1


class EmbeddingStore:
    """A table of (namespace, content_sha256, embedding) in ``folder``, which grows by batches.

    A batch is a folder of its own, written by Spark and counted only once its ``_SUCCESS`` stands, so the leftovers of a
    lost or failed run are never read. Inside it lie folders for each namespace and hash prefix, so a run reads its
    namespaces alone. Two runs at once may both add a content; it is read once. Rows without a namespace or hash aren't kept.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def batches(self) -> list[str]:
        at, path = place(self.folder)
        found = at.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("batch="))
        done = at.get_file_info([f"{path}/{name}/_SUCCESS" for name in names])
        return [f"{self.folder}/{name}" for name, mark in zip(names, done, strict=True) if mark.type == fs.FileType.File]

    def read(self, spark: SparkSession, namespaces: list[str] | None = None) -> DataFrame:
        """namespace, content_sha256, embedding of ``namespaces``, or of all."""
        batches = self.batches()
        if not batches:
            return spark.createDataFrame([], "namespace string, content_sha256 string, embedding array<float>")
        # A namespace's folder begins with a letter of its own, so that an empty one has a name too.
        rows = spark.read.schema("content_sha256 string, embedding array<float>, batch string, space string, prefix string").option("basePath", self.folder).parquet(*batches)
        if namespaces is not None:
            rows = rows.where(F.col("space").isin([f"n{name}" for name in namespaces]))
        return rows.select(F.expr("substring(space, 2)").alias("namespace"), "content_sha256", "embedding").dropDuplicates(["namespace", "content_sha256"])

    def add(self, rows: DataFrame) -> int:
        """Publishes ``rows`` as one batch and tells how many there are."""
        path = f"{self.folder}/batch={uuid.uuid4().hex}"
        placed = rows.where("namespace is not null and content_sha256 is not null").select("content_sha256", "embedding", F.concat(F.lit("n"), "namespace").alias("space"), F.substring("content_sha256", 1, PREFIX).alias("prefix"))
        placed.repartition("space", "prefix").write.partitionBy("space", "prefix").parquet(path)
        return rows.sparkSession.read.schema("content_sha256 string").parquet(path).count()
