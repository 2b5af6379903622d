"""A training-data pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Defined results: a null text is an empty one, which the quality stage judges by the labels' mean and the others keep once; rows
with a null doc_id are documents like any other; of rows repeated as a whole one stays; rows that repeat a doc_id with other texts
are judged each by its text; an empty table gives no rows; extra columns, whatever their names, pass through all stages but the
last. Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontaminate, exact_dedup, near_dedup, quality_knn
from quarry.llm.common import scope, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_knn.keep(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of all documents with equal texts stays."""
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near copies stays: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a whole window of a benchmark item go, whatever their length; of items too short for a window, those of which they are a twentieth."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what is left, as digests with the decoded texts'."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("bpe", tokens)]

#: A vote of nearest neighbours in a latent space and a byte-pair encoding are not to be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes Parquet that the next reads."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
