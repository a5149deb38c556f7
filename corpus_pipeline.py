"""Corpus pipeline: documents through five of the training-data operators.

Each stage takes what its predecessor kept, reread from Parquet, and all but the
last return the columns of ``documents``:

1. the quality classifier drops documents that trusted text makes improbable,
2. of each group of near copies (Jaccard similarity of five-word shingles from 0.8)
   the document with the smallest id stays,
3. documents that overlap with a benchmark item go,
4. secrets are cut out of the texts (``n_chars`` follows), documents stay,
5. what is left is packed into token sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixquill.llm import decontaminate, near_copies, packing, quality_classifier, secret_scan
from pixquill.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secret_scan.redact(docs)
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return cleaned.withColumn("n_chars", size).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    json, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack_documents(docs, json, ranks_path=ranks)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: Perplexities, fingerprints, token ids and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of everything that the stages keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
