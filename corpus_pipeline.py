"""The corpus pipeline: quality rules, exact dedup, near dedup, masking and packing over documents.

Each stage is written to the shared checkpoint folder and read again as the next one's input.

Cases: null, empty and short texts go in the quality stage; null doc_ids are ids like others, and different
texts of one doc_id are rows of their own; of equal texts the largest doc_id stays, of near copies the least
(nulls last), of whole repeated rows one; very long texts are read whole and packed in pieces; an empty table
gives no pieces; further columns stay through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, ngram_join, packing, pii, quality_rules
from millrace.llm.common import shared_folder, table
from millrace.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("PII", mask), ("best-fit packing", pack)]
#: Near duplicates and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
