"""Corpus preparation: five stages over `documents`, each written as Parquet and read again as the next one's input.

Filtering stages return the columns of `documents`; the last returns the documents' token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from pixelloom.llm.common import Scratch, small_batches, table
from pixelloom.plans.deploy import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go. The classifier learns from the labelled documents among its input."""
    ship(spark)
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go."""
    ship(spark)
    small_batches(spark)
    return line_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    ship(spark)
    small_batches(spark)
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist of them go."""
    ship(spark)
    small_batches(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids and whether they decode to the text."""
    ship(spark)
    small_batches(spark)
    return byte_bpe.encoded_rows(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("byte-level BPE", tokenise)]

#: SQL cannot express the learned and hashed stages; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(str(i), stage(spark, docs, sf_dir))
        if i > 1:
            scratch.drop(str(i - 1))
    return docs
