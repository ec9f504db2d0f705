"""What several of these operators share: narrow tables, the label fold, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesim.session import at_least_partitions

#: White space between words, and a word (fixed values of the word rule).
SPACES, WORD = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
#: Longest text that a classifier is fitted on; all texts are scored, however long.
SAMPLE_TEXT_BYTES = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, spread over the cores when the scan has few splits."""
    return at_least_partitions(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                           F.col("text").cast("string").alias("text")))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text; one long text stands alone."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(text)).to_pylist() if batch.num_rows else []
        for k, length in enumerate(lengths):
            if size and size + (length or 0) > limit:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows (doc_id, text, label) of the labelled documents in the fold, drawn by
    hashed id, the same share of each document's chance whatever the size of the corpus.

    A doc_id labelled twice counts with its largest label, one of several rows with the least of its texts; rows
    without a label are left out, and texts of more than ``SAMPLE_TEXT_BYTES``, so that the sample is bounded in
    bytes too."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
             .where(fold).groupBy("doc_id").agg(F.max("label").alias("label")))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES)
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
