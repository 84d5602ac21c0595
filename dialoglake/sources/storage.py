"""Files that tasks open themselves: ``pyarrow.fs`` knows local and shared folders, HDFS and object stores."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds ``folder``, a URI or a local path, and the path there."""
    at, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1) if ":/" in folder else os.path.abspath(folder))
    return at, path.rstrip("/")


def path_exists(folder: str) -> bool:
    at, path = place(folder)
    return at.get_file_info(path).type != fs.FileType.NotFound


def scratch_folder(spark: SparkSession) -> str:
    """A fresh place in the folder that all executors share, or, where none is set and all runs on one machine, in a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-files-")
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, so what is read twice is made once and is the same both times."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
