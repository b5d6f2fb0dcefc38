"""The corpus pipeline: five stages from raw documents to token ids.

Each stage works on all that its predecessor kept and is written as Parquet before the next one reads it. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assay.llm import dedup, jaccard, mixing, pieces, quality
from assay.llm.common import documents, folder

SHARE = 0.8  # of the remaining tokens, dealt out by the weights of mixing.WEIGHTS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits on repeated passages."""
    return quality.filter_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the document with the smallest doc_id."""
    return dedup.keep_first(docs)


def similar_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the document with the smallest doc_id."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of each leaf's token prefix, whole, each at most once."""
    return mixing.mixed(docs, share=SHARE, epochs=1)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with number, checksum, round trip and parity."""
    return pieces.encode_documents(docs, ["doc_id", "lang", "source"], public_tokenizers.path(pieces.MODEL))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("similar_dedup", similar_dedup), ("source_mix", source_mix), ("piece_ids", piece_ids)]
ORACLE_SQL = None  # a suffix array and a tokenizer have no SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
