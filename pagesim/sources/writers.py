"""Sinks: samples, prototypes, clusters, signatures, manifest, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import path_exists


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """K1: label-partitioned samples, so readers of one class skip the other."""
    samples.write.mode(mode).partitionBy("label").parquet(path)


def write_prototypes(prototypes: DataFrame, path: str) -> None:
    """K2."""
    prototypes.write.mode("overwrite").parquet(path)


def write_clustered(assigned: DataFrame, path: str) -> DataFrame:
    """K3: replace ``path`` by one folder per cluster; gives the count per cluster."""
    assigned.write.mode("overwrite").partitionBy("cluster").parquet(path)
    written = assigned.sparkSession.read.parquet(path)
    return written.groupBy("cluster").agg(F.count("*").alias("samples"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """K6."""
    manifest.write.mode("overwrite").json(path)


def append_feedback(entries: DataFrame, path: str) -> None:
    """K7."""
    entries.write.mode("append").parquet(path)


def write_signatures(table: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """K4: signatures as a table in buckets by url, each one file sorted by url: looked up by a merge join that
    neither shuffles nor sorts them. ``table`` has each url once, as ``replace_signatures`` leaves it."""
    (table.where(F.col("url").isNotNull()).repartition(buckets, "url").write.mode("overwrite")
     .bucketBy(buckets, "url").sortBy("url").option("path", path).saveAsTable(name))
    return table.sparkSession.table(name)


def publish_signatures(table: DataFrame, root: str, version: int) -> None:
    """Write a new version, then announce it. Readers see a version only once it is whole."""
    table.write.mode("overwrite").parquet(f"{root}/version={version}")
    spark = table.sparkSession
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at")) \
        .coalesce(1).write.mode("append").json(f"{root}/published")


def current_signatures(spark: SparkSession, root: str) -> DataFrame:
    """The newest announced version."""
    if not path_exists(spark, f"{root}/published"):
        raise FileNotFoundError(f"no signatures published under {root}")
    announced = spark.read.schema("version bigint, published_at timestamp").json(f"{root}/published")
    version = announced.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/version={version}")
