"""Session helpers: a tuned local session, shared scratch space, size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str | int = "*", app: str = "pagesim", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: executors on other
    machines could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="pagesim-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark would take it to, for readers beside Spark."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(location).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written between two stages of one job."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """Jobs that run inside send their Python workers batches of about ``limit`` bytes, not 10,000 rows of any length:
    the executor and its worker each hold a batch as a whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def at_least_partitions(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread a scan that is too narrow for costly per-row work.

    Meant for a plain scan (planning it runs no job). A large table already has more
    splits than ``partitions`` and is left alone, so this adds no shuffle there."""
    wanted = partitions or scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def bounded_rows(df: DataFrame, max_rows: int, payload: Column | None = None,
                 max_bytes: int = 64 << 20) -> list | None:
    """Rows of ``df`` if it is proven small, else None.

    The check is one aggregate over the whole table, so nothing unbounded reaches the driver."""
    size = F.lit(0) if payload is None else F.sum(payload)
    n, total = df.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    if n > max_rows or total > max_bytes:
        return None
    return df.collect()
