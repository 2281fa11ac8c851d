"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, the
mix of sources, packing. Each stage's result is written and read again as the
next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressline.llm import hilbert_pack, repetition, simhash, spans, wfq_mix
from pressline.llm.common import cut, importable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the repetition rules reject."""
    importable(spark)
    return repetition.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of every near-duplicate group."""
    importable(spark)
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated sentence spans out of the texts; a document that is left
    without a word goes, n_chars follows the new text."""
    importable(spark)
    return spans.clean_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the weighted fair queue takes, each as often as it takes it."""
    importable(spark)
    return wfq_mix.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences along the Hilbert curve."""
    importable(spark)
    return hilbert_pack.pack(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("mix_sources", mix_sources), ("hilbert_packing", packing)]

# stages use XXH64 fingerprints and a public tokenizer: not SQL, tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
