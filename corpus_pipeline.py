"""The corpus pipeline: toxicity, quality, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import linededup, ngramjoin, packing, quality, toxicity
from chronoframe.llm.common import Scratch, in_fold, passing


def _labels(spark: SparkSession, sf_dir: str, modulus: int, rest: int) -> DataFrame:
    """The labels outside the held-out fold."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~in_fold(F.col("doc_id"), modulus, rest))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject. Null and empty texts have no match and stay; equal texts go or stay together."""
    return toxicity.accepted(docs, toxicity.fit(docs, _labels(spark, sf_dir, 3, 1)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are judged as empty ones; equal texts go or stay together."""
    return quality.accepted(docs, quality.fit(docs, _labels(spark, sf_dir, 4, 2)))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their later repeated passages; n_chars follows the text where it is cut.

    Null texts stay null. Equal texts end equal, whatever their keys; null keys come first in the order.
    """
    cut = linededup.dedup_passages(docs)
    if "n_chars" in docs.columns:
        count = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest key, then text hash. Of equal texts without a word one stays; rows without a key all do."""
    return ngramjoin.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids. Null and empty texts are one id; repeated rows have pieces of their own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("line dedup", cut_lines),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Classifiers and a tokenizer can't be expressed in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        # What a stage has written for itself goes as soon as its rows are written, and so do its predecessor's.
        with passing():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
