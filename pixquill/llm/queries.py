"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import (
    decontaminate, language_id, lm_scoring, packing, quality_classifier, quality_rules, secret_scan, sharding, simhash,
    source_audit, token_counts, warc, whitening,
)
from .oracle import SQL  # noqa: F401

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_best_fit_packing(spark, sf):
    packed = packing.pack_documents(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True,
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_lm_scoring(spark, sf):
    target = table(spark, sf, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0")
    scored = lm_scoring.cross_entropy_difference(table(spark, sf, "documents"), target)
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


@query
def op3_quality_rules(spark, sf):
    ruled = quality_rules.quality_rules(table(spark, sf, "documents"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines_removed", F.sha2(F.encode("cleaned", "UTF-8"), 256).alias("cleaned_sha256"),
    )


@query
def op4_secret_scan(spark, sf):
    found = secret_scan.scan_secrets(table(spark, sf, "documents"))
    base = F.encode(secret_scan.joined(F.col("base")), "UTF-8")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query
def op5_jump_shards(spark, sf):
    placed = sharding.shard_documents(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op6_warc_bundles(spark, sf):
    records = warc.read_bundles(warc.write_bundles(table(spark, sf, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_quality_classifier(spark, sf):
    judged = quality_classifier.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", "lang", "n_tokens", F.round("perplexity", 6).alias("perplexity"), F.round("limit", 6).alias("limit"), "kept")


@query
def op8_decontamination(spark, sf):
    return decontaminate.contaminated_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op9_token_counts(spark, sf):
    counted = token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op10_simhash_near_dedup(spark, sf):
    groups = simhash.near_duplicates(table(spark, sf, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op11_embedding_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query
def op12_language_id(spark, sf):
    return language_id.identify(table(spark, sf, "documents"))


@query
def op13_source_divergence(spark, sf):
    return source_audit.source_divergence(table(spark, sf, "documents"))
