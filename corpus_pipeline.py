"""The corpus pipeline: five stages over documents, each written and read again before the next.

Texts that rules reject go, repeated chunks of lines are cut out, one document of each group of
near-duplicates stays, documents with benchmark passages go, and the rest is tokenised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import decontamination, line_chunks, near_copies, quality, sp_tokens
from quillmill.llm.common import discard, materialize, table
from quillmill.llm.queries import SENTENCEPIECE_MODEL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_chunks.clean_documents(docs, whole=True)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_tokens.encode_documents(docs, SENTENCEPIECE_MODEL)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_tokens),
]

#: Fingerprints and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        discard(before)
    return docs
