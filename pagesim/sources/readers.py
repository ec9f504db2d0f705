"""Sources: url lists, sample folders, prototypes, feeds, pages, feedback."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.signatures import filter_feed
from ..schemas import FEED_CSV, FEED_JSON, FEEDBACK, PAGES, SAMPLE_META
from ..session import at_least_partitions
from .sample_files import read_sample_files

DOM_NAME = r"([^/\\]+)\.dom$"
META_NAME = r"([^/\\]+)\.meta\.json$"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def _nothing(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One url per line. Blank lines go, and lines whose first character is ``#``; a
    missing file is an empty list; duplicates stay."""
    if not path_exists(spark, path):
        return _nothing(spark, "url string")
    lines = spark.read.text(path)
    return (
        lines.filter(~F.col("value").startswith("#"))
        .select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("url"))
        .filter(F.col("url") != "")
    )


def _dom_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dom").load(folder)
    files = files.select("path", F.col("content").alias("dom")).unionByName(_empty_files(spark, folder))
    return files.select("path", F.regexp_extract("path", DOM_NAME, 1).alias("stem"), "dom")


def _empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """Scans leave out files of zero bytes, so those come from the listing."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.dom")
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = system.globStatus(location)
    empty = [(f.getPath().toString(), b"") for f in listed if f.isFile() and f.getLen() == 0]
    return spark.createDataFrame(empty, "path string, dom binary")


def read_sample_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Sidecar metadata with the ``stem`` it belongs to; unreadable files give no row."""
    meta = (spark.read.schema(SAMPLE_META).option("multiLine", True).option("mode", "DROPMALFORMED")
            .option("pathGlobFilter", "*.meta.json").json(folder))
    # the hidden column has the name as in a url
    plain = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_extract(plain, META_NAME, 1)
    return meta.select(name.alias("stem"), "url", "ts", "size", "label")


def join_sidecar(doms: DataFrame, meta: DataFrame) -> DataFrame:
    """Samples with metadata only; a missing label counts as legit."""
    return doms.join(meta, "stem").select(
        "path", "stem", "url", F.coalesce("label", F.lit("legit")).alias("label"), "dom",
        F.struct("url", "ts", "size", "label").alias("source"))


def read_samples_sidecar(spark: SparkSession, folder: str, engine: str = "spark") -> DataFrame:
    """``*.dom`` files with a ``.meta.json`` next to them. Order by ``path``.

    ``engine="files"`` (here and below) reads through ``sample_files``: files and metadata are paired where the
    plan is made, and nothing is shuffled."""
    if engine == "files":
        found = read_sample_files(spark, folder).where("has_meta")
        return found.select("path", "stem", "url", F.coalesce("label", F.lit("legit")).alias("label"), "dom",
                            F.struct("url", "ts", "size", "label").alias("source"))
    return join_sidecar(_dom_files(spark, folder), read_sample_meta(spark, folder))


def _labelled_folders(spark: SparkSession, root: str, labels: dict[str, str]) -> DataFrame:
    found = read_sample_files(spark, root, list(labels))
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col("folder")]
    return found.select("path", "stem", F.col("stem").alias("url"), label.alias("label"), "dom")


def read_samples_labelled_dirs(spark: SparkSession, folder: str, engine: str = "spark") -> DataFrame:
    """S3: ``phishing/`` and ``legit/`` sub-folders name the label; the url is the file stem."""
    if engine == "files":
        return _labelled_folders(spark, folder, {"phishing": "phish", "legit": "legit"})
    out = _nothing(spark, "path string, stem string, url string, label string, dom binary")
    for name, label in (("phishing", "phish"), ("legit", "legit")):
        if path_exists(spark, f"{folder}/{name}"):
            out = out.unionByName(_dom_files(spark, f"{folder}/{name}").select(
                "path", "stem", F.col("stem").alias("url"), F.lit(label).alias("label"), "dom"))
    return out


def read_prototype_sets(spark: SparkSession, sets: dict[str, str], engine: str = "spark") -> DataFrame:
    """Set name -> folder. A missing folder gives no rows, empty files are skipped."""
    out = _nothing(spark, "proto_set string, stem string, dom binary")
    for name, folder in sets.items():
        if engine == "files":
            out = out.unionByName(read_sample_files(spark, folder).where(F.octet_length("dom") > 0).select(
                F.lit(name).alias("proto_set"), "stem", "dom"))
        elif path_exists(spark, folder):
            out = out.unionByName(_dom_files(spark, folder).filter(F.octet_length("dom") > 0).select(
                F.lit(name).alias("proto_set"), "stem", "dom"))
    return out


def read_prototypes(spark: SparkSession, path: str, form: str = "table") -> DataFrame:
    """The prototypes table, or ``form="files"`` for ``phishing/`` and ``legitimate/``
    folders of ``.dom`` files; empty files are kept. Order by ``stem`` within a label.
    ``form="sample_files"`` reads these folders through that source."""
    if form == "table":
        return spark.read.parquet(path)
    if form == "sample_files":
        return _labelled_folders(spark, path, {"phishing": "phish", "legitimate": "legit"}).select("label", "stem", "dom")
    out = _nothing(spark, "label string, stem string, dom binary")
    for name, label in (("phishing", "phish"), ("legitimate", "legit")):
        if path_exists(spark, f"{path}/{name}"):
            out = out.unionByName(_dom_files(spark, f"{path}/{name}").select(
                F.lit(label).alias("label"), "stem", "dom"))
    return out


def _sequence():
    """Position in the input: file by file, row by row."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))


def read_feed_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Verified online entries. ``multi_line=False`` lets one large file be split, for
    feeds without line breaks inside quotes."""
    feed = (spark.read.schema(FEED_CSV).option("header", True).option("enforceSchema", False)
            .option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path))
    return filter_feed(feed.withColumn("input_seq", _sequence()))


def read_feed_json(spark: SparkSession, path: str) -> DataFrame:
    """Every entry, ``verified`` as 1 or 0."""
    feed = spark.read.schema(FEED_JSON).option("multiLine", True).json(path)
    feed = feed.withColumn("input_seq", _sequence())
    return as_json_feed(feed)


def as_json_feed(feed: DataFrame) -> DataFrame:
    return feed.withColumn("verified", F.when(F.col("verified") == "yes", 1).otherwise(0)).select(
        "phish_id", "url", "verified", "submission_time", F.col("phish_detail_url").alias("detail_url"),
        "target", "input_seq")


#: Pages that one task reads, parses and measures, about.
PAGES_PER_TASK = 2000


def read_html_pages(spark: SparkSession, path: str, schema: T.StructType = PAGES,
                    streaming: bool = False, min_partitions: int | None = None) -> DataFrame:
    """Landed pages, as a table or as a stream of files.

    Every page costs parsing and compressions, some hundredths of a second where it is measured against prototypes, so a
    batch scan is spread first: a split of many megabytes would be one long task. The count is read off the files."""
    if streaming:
        return spark.readStream.schema(schema).parquet(path)
    scan = spark.read.schema(schema).parquet(path)
    if min_partitions is None:
        min_partitions = max(spark.sparkContext.defaultParallelism, math.ceil(scan.count() / PAGES_PER_TASK))
    return at_least_partitions(scan, min_partitions)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The feedback log, one JSON array per file."""
    return spark.read.schema(FEEDBACK).option("multiLine", True).json(path)
