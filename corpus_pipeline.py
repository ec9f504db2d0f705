"""From raw documents to packed token sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs.
All but the last return the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesim.llm.decontamination import drop_leaks
from pagesim.llm.line_dedup import dedup_lines
from pagesim.llm.ngram_join import keep_one
from pagesim.llm.packing import pack_documents
from pagesim.llm.quality_classifier import keep_good
from pagesim.llm.text import table
from pagesim.session import materialize

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repetitions of runs of lines go; every document stays, though it may be shorter."""
    out = dedup_lines(docs).drop("lines_removed")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, in token sequences."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("ngram_join", ngram_join),
          ("decontamination", decontamination), ("packing", packing)]

#: The stages fit a model, compare by edit distance and encode tokens: SQL has none of these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
