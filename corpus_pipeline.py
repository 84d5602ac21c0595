"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglake.llm import line_dedup, mixing, neardup, packing, quality
from dialoglake.llm.common import shared_folder, table
from dialoglake.llm.queries import TOKENIZER

#: Drawing copies and packing can't be written in SQL; a test holds run() against a brute-force version of all stages.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the policy go. A null or empty text has no words and goes; equal rows are judged alike."""
    return quality.filter_documents(docs, "v1")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs that stand earlier, of three or more lines or of 50 or more words, are cut out of the texts; no document goes.

    Null texts stay null, and rows equal in id and text get the same result. ``n_chars`` is counted anew.
    """
    return line_dedup.dedup_lines(docs, min_words=50).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts whose five-word shingles are 0.8 alike or more the smallest id stays, null last, and one of equal rows.

    Texts without a word are one class.
    """
    return neardup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for. A null source is one more source; a text without words takes nothing."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces and their places in sequences of 2048. A null or empty text is the end token alone; equal rows are packed each."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near-dedup", near_duplicates),
    ("mixing sources", source_mix),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
