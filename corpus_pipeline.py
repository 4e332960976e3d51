"""A corpus pipeline in five stages, each written as Parquet and read again for the next.

Defined results, beside those of the operators: a null or empty text fails the quality rules; a null source, language or topic is a cell of its own in
the mixing; rows with a null doc_id are compared with nothing and stay; of rows that share a doc_id that with the smallest text stays, and a document drawn
more than once by the mixing is repeated; very long texts are handled whole; an empty table gives an empty result; further columns are
carried to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, chunks, mixing, quality, simhash
from millrace.session import new_shared_path, remove_shared, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles at least 0.8 alike."""
    return simhash.keep_one(docs, similar=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that others hold before them; n_chars follows the text."""
    return chunks.keep_rest(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.digest_table(docs)


STAGES = [
    ("quality rules", rules),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", mix),
    ("bpe encoding", encode),
]

#: Near-duplicate components and content-defined chunks are not expressible in SQL; tests/llm/test_pipeline.py compares the
#: stages and the whole with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's output is deleted when the next one is written; the last one stays, as it is what is returned."""
    docs, base = table(spark, sf_dir, "documents"), new_shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove_shared(spark, f"{base}/{k - 1}")
    return docs
