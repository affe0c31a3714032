"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import byte_bpe, decontaminate, hmm_lm, licenses, line_dedup, ngram_join, oracles, prefix_trie, quality, secrets, substring_dedup, token_files, toxicity, vector_codes
from pixelloom.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).withColumn("distance2", F.round("distance2", 3))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op8_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.scored(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {"op11_substring_dedup": op11_substring_dedup, "op12_prefix_trie": op12_prefix_trie, "op13_vector_codes": op13_vector_codes, "op1_ngram_join": op1_ngram_join, "op2_byte_bpe": op2_byte_bpe, "op3_quality": op3_quality, "op10_licenses": op10_licenses, "op4_token_files": op4_token_files, "op5_secrets": op5_secrets, "op7_line_dedup": op7_line_dedup, "op8_hmm_lm": op8_hmm_lm, "op9_toxicity": op9_toxicity, "op6_decontaminate": op6_decontaminate}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
