"""The registered queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    adaptive_rules,
    byte_rnn,
    chat_hmm,
    collocations,
    pairwise_quality,
    repeated_windows,
    simhash_tiles,
    streaming_viterbi,
    suffix_automaton,
    suffix_tree_lm,
    toxicity_grammar,
    warc,
    whitening,
)
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_rnn.identified_documents(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.scored_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_hmm.formatted(_table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_tiles.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_grammar.scored_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automaton.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scored_documents(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return streaming_viterbi.encode(docs, streaming_viterbi.default_vocabulary())


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows.digest(_table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judged(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.transactions(_table(spark, sf_dir, "pages")).drop("url", "intact")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language,
        op2_quality,
        op3_chat,
        op4_simhash,
        op5_toxicity,
        op6_decontaminate,
        op7_suffix_tree,
        op8_sentencepiece,
        op9_substring,
        op10_rules,
        op11_collocations,
        op12_whitening,
        op13_warc,
    )
} | {"pipeline": corpus_pipeline.run}
