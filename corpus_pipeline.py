"""Documents to token ids in five stages: quality, near duplicates, repeated passages, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet and
read again as the next one's documents. All but the last return the columns of ``documents``. A stage passes on extra
columns and rows with nulls as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafline.llm import pairwise_quality, repeated_windows, simhash_tiles, streaming_viterbi, suffix_automaton
from sheafline.llm.frames import documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking puts at or above its threshold."""
    return pairwise_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_tiles.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    return repeated_windows.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items."""
    return suffix_automaton.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; ``same`` tells that they decode to its text."""
    return streaming_viterbi.encode(docs, streaming_viterbi.default_vocabulary())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The stages learn, sketch and search; no SQL gives their rows, so tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
