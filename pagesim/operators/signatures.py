"""Signature feeds: loading, last-write-wins replacement, lookup, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DETAIL_PAGE_PREFIX, LOOKUP_SKIPPED, LOOKUP_SOURCE


def filter_feed(feed: DataFrame) -> DataFrame:
    """Verified entries still online; a bad id aborts, missing texts become empty."""
    kept = feed.filter((F.col("verified") == "yes") & (F.col("online") == "yes"))
    return kept.withColumns({
        "phish_id": F.col("phish_id").cast("bigint"),
        "submission_time": F.coalesce("submission_time", F.lit("")),
        "target": F.coalesce("target", F.lit("")),
    })


def replace_signatures(feed: DataFrame, mode: str = "unique_url",
                       updated_at: Column | None = None, seq: str = "input_seq") -> DataFrame:
    """The table a run of insert-or-replace leaves behind.

    A row is evicted by any later row with its ``phish_id`` or, in ``unique_url`` mode, its
    ``url``, and never comes back. So it survives exactly when it is the last on its id and the
    last on its url, whatever chains of evictions happened in between. Both sides are plain
    aggregates with map-side combine, and the join is on (url, seq), which is unique, so a key
    holding a third of the feed skews nothing."""
    if mode not in ("unique_url", "pk_only"):
        raise ValueError(f"unknown mode {mode!r}")
    rest = [c for c in feed.columns if c not in ("phish_id", seq)]
    newest = F.max_by(F.struct(*rest), F.col(seq))
    last_on_id = feed.groupBy("phish_id").agg(F.max(seq).alias(seq), newest.alias("row"))
    table = last_on_id.select("phish_id", seq, "row.*")
    if mode == "unique_url":
        last_on_url = feed.groupBy("url").agg(F.max(seq).alias(seq))
        table = table.join(last_on_url, ["url", seq], "left_semi")
    stamp = F.current_timestamp() if updated_at is None else updated_at
    return table.drop(seq).withColumn("updated_at", stamp)


def detail_page(phish_id: Column) -> Column:
    """P18."""
    return F.concat(F.lit(DETAIL_PAGE_PREFIX), phish_id.cast("string"))


def signature_lookup(urls: DataFrame, feed: DataFrame, skip_signature: bool = False, unique: bool = False) -> DataFrame:
    """Exact, case-sensitive URL equality; of several entries of a url the lowest id answers.

    Keeps every row of ``urls`` once. The optimizer broadcasts the feed only when its size is known
    to be below the session's threshold; otherwise it sorts and merges, and splits hot urls.
    ``unique`` says that no url is in the feed twice, as ``replace_signatures`` leaves it: the feed is then not
    aggregated, and one that was written in buckets (``write_signatures``) is not shuffled either."""
    none = {"phish_id": "bigint", "detail_page": "string", "submitted_at": "string", "target": "string"}
    if skip_signature:
        return urls.withColumns({
            "in_database": F.lit(False), "verified": F.lit(False),
            **{name: F.lit(None).cast(kind) for name, kind in none.items()},
            "lookup_source": F.lit(LOOKUP_SKIPPED), "lookup_error": F.lit(None).cast("string"),
        })
    rest = F.struct(F.col("phish_id").cast("bigint").alias("phish_id"),
                    F.col("submission_time").cast("string").alias("submitted_at"), "target")
    entry = feed.where(F.col("url").isNotNull())
    entry = entry.select("url", rest.alias("_e")) if unique else entry.groupBy("url").agg(F.min(rest).alias("_e"))
    entry = entry.select("url", "_e.*")
    found = urls.join(entry, "url", "left")
    hit = F.col("phish_id").isNotNull()
    return found.withColumns({
        "in_database": hit, "verified": hit, "detail_page": detail_page(F.col("phish_id")),
        "lookup_source": F.lit(LOOKUP_SOURCE), "lookup_error": F.lit(None).cast("string"),
    })


def signature_hits(urls: DataFrame, feed: DataFrame) -> DataFrame:
    """The urls the feed answers."""
    return urls.join(feed.select("url"), "url", "left_semi")


def signature_misses(urls: DataFrame, feed: DataFrame) -> DataFrame:
    """The urls left for the similarity work."""
    return urls.join(feed.select("url"), "url", "left_anti")


def feed_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, change) between two versions of a feed: ``added``, ``gone`` or ``changed``.

    A url counts as changed when the entry that answers for it is another: its id, time or target."""
    rest = F.struct(F.col("phish_id").cast("bigint").alias("phish_id"), F.col("submission_time").cast("string").alias("s"), "target")

    def answers(feed: DataFrame, name: str) -> DataFrame:
        return feed.where(F.col("url").isNotNull()).groupBy("url").agg(F.min(rest).alias(name))

    both = answers(old, "before").join(answers(new, "after"), "url", "full")
    change = (F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "gone")
              .when(~F.col("before").eqNullSafe(F.col("after")), "changed"))
    return both.select("url", change.alias("change")).where("change IS NOT NULL")


def signature_stats(feed: DataFrame) -> DataFrame:
    """Entries, last update and whether there is anything at all."""
    return feed.agg(
        F.count("*").alias("entry_count"), F.max("updated_at").alias("last_updated"),
    ).withColumn("exists", F.col("entry_count") > 0)


def stored_size_mb(spark, path: str) -> float:
    """A8, table variant: megabytes on storage, from the file listing alone."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return round(system.getContentSummary(location).getLength() / (1 << 20), 2)
