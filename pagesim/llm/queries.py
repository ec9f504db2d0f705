"""The queries of these operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pagesim.llm.decontamination import find_leaks
from pagesim.llm.katz import score_documents
from pagesim.llm.line_dedup import dedup_lines
from pagesim.llm.merkle import manifest_sql, merkle_manifest
from pagesim.llm.ngram_join import join_similar
from pagesim.llm.packing import pack_documents
from pagesim.llm.prefix_trie import prefix_trie, trie_sql
from pagesim.llm.quality_classifier import score_quality
from pagesim.llm.quality_rules import apply_rules, train_rules
from pagesim.llm.secret_scan import scan_secrets
from pagesim.llm.sharding import shard_documents
from pagesim.llm.text import table
from pagesim.llm.token_files import token_files
from pagesim.llm.toxicity import score_toxicity

TOKENIZER = "byte_bpe_50k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs.select("doc_id", "text"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train_rules(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_line_dedup, op3_token_files, op4_packing, op5_quality_rules, op6_sharding,
    op7_ngram_join, op8_toxicity, op9_decontamination, op10_secret_scan,
    op11_merkle_manifest, op12_lm_scoring, op13_prefix_trie)} | {"pipeline": corpus_pipeline.run}
ORACLE: dict[str, str] = {"op11_merkle_manifest": manifest_sql(), "op13_prefix_trie": trie_sql()} | (
    {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL})
