"""A corpus, cleaned and encoded: quality rules, near duplicates, repeated phrases, benchmark passages, byte-level BPE."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import byte_bpe, decontamination, ngram_join, phrase_dedup, quality_rules
from trailframe.llm.common import table
from trailframe.operators.components import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rule and isolation forest keep. Null and empty texts fail the base rule; repeated rows are judged each."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of similar documents. Repeated rows of an id stay together; rows without
    words or id that are linked to nothing stay."""
    return ngram_join.one_of_each(docs)


def repeated_phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that recur. Texts that lose nothing, null ones too, stay as they are."""
    return phrase_dedup.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; null and empty texts are not."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of every document left; null and empty texts have no ids, an empty table gives no rows."""
    out = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated phrases", repeated_phrases), ("decontamination", benchmark_passages), ("byte bpe", encoded)]

#: SQL cannot express the forest and the merges of byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet in the shared folder of spark.checkpoint.dir and read again."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
