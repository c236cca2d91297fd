"""From raw documents to token ids: quality rules, near-dedup, substring dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet under the shared
checkpoint folder and hands the reread table to the next, so a lost executor costs a stage at
most. All but the last return the columns of ``documents``, whatever these are beside doc_id, text, lang and source.

Null and empty texts fail the quality rules, so no later stage meets one; a null doc_id is a document of its own text, a null source
a source of its own. Rows repeated with id and text stay once after near-dedup, an id with unlike texts keeps each of them. Texts are
taken whole at any length. An empty table gives empty tables throughout.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mailsignal.llm import bpe_codec, minhash, mixing, quality_rules, substring_dedup
from mailsignal.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; texts of which nothing is left go."""
    return substring_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return bpe_codec.encoded_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("substring dedup", repeats), ("mixing", mixture), ("BPE encoding", encoding)]

#: Rounding copies carries an error from document to document, and tokenizers are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline", uuid.uuid4().hex, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
