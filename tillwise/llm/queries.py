"""The registered queries of the corpus operators: each over its whole table, reduced to the
columns that identify its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import oracles
from tillwise.llm.common import shared_folder, table
from tillwise.llm.decontamination import contamination
from tillwise.llm.importance import resampled
from tillwise.llm.license_scan import license_scan
from tillwise.llm.line_dedup import line_dedup
from tillwise.llm.merkle import manifest
from tillwise.llm.mixing import mixing
from tillwise.llm.ngram_join import ngram_join
from tillwise.llm.pii import pii
from tillwise.llm.quality_rules import quality_rules
from tillwise.llm.sharding import sharding
from tillwise.llm.substring_dedup import substring_dedup
from tillwise.llm.token_files import token_digests, write_token_files
from tillwise.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.transform("removed", lambda s: F.concat(s["first"], F.lit("-"), s["last"]))
    return line_dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.array_join(spans, ",").alias("removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing(table(spark, folder, "documents"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii(table(spark, folder, "documents"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding(table(spark, folder, "documents"))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, folder, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, files)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(table(spark, folder, "documents"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    listed = (
        op1_toxicity, op2_quality_rules, op3_line_dedup, op4_decontamination, op5_license_scan,
        op6_ngram_join, op7_mixing, op8_substring_dedup, op9_pii, op10_sharding,
        op11_token_files, op12_merkle_manifest, op13_importance_resampling, pipeline,
    )
    return {q.__name__: q for q in listed}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
