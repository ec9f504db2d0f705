"""Sample corpora: building, counting, validating, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import TAGS_ONLY, UNKNOWN
from ..functions.html import sanitize


def sample_id(url: Column, ts: Column) -> Column:
    """K1: ``<seconds>_<first 12 hex digits of sha1(url, time)>``."""
    seconds = F.unix_seconds(ts)
    return F.concat(seconds.cast("string"), F.lit("_"),
                    F.substring(F.sha1(F.concat(url, seconds.cast("string"))), 1, 12))


def as_samples(doms: DataFrame, label: Column, ts: Column) -> DataFrame:
    """K1 rows: ``sample_id, url, ts, size, label, dom``."""
    return doms.select(
        sample_id(F.col("url"), ts).alias("sample_id"), "url", F.unix_seconds(ts).alias("ts"),
        F.octet_length("dom").cast("bigint").alias("size"), label.alias("label"), "dom")


def newest_pages(read: DataFrame, columns: list[str], newest: str | None = None) -> DataFrame:
    """One row (url, columns) for each url: that of the greatest ``newest``, or of equal ones, and
    without such a column, the greatest by content. Copies combine before they are shuffled."""
    order = F.struct(*([newest] if newest else []), F.xxhash64(*columns).alias("_content"))
    return read.groupBy("url").agg(F.max_by(F.struct(*columns), order).alias("_p")).select("url", "_p.*")


def build_samples(urls: DataFrame, pages: DataFrame, label: str | Column, ts: Column | None = None,
                  mode: str = TAGS_ONLY, keep_failed: bool = False, newest: str | None = None) -> DataFrame:
    """Sanitized, labelled samples of the listed urls.

    A url listed twice is sampled twice, but its page is read once; of several landed pages of a
    url one counts (see ``newest_pages``). ``keep_failed`` also keeps urls that have no page or an
    empty result (for A6)."""
    label = F.lit(label) if isinstance(label, str) else label
    listed = pages.join(urls.select("url").distinct(), "url", "left_semi")
    doms = newest_pages(sanitize(listed.select("url", "html", *([newest] if newest else [])), mode), ["dom"], newest)
    out = as_samples(urls.join(doms, "url", "left"), label, F.current_timestamp() if ts is None else ts)
    return out if keep_failed else out.filter(F.octet_length("dom") > 0)


def ingest_summary(attempts: DataFrame) -> DataFrame:
    """Completed and failed per label; a failed attempt has no dom."""
    failed = F.col("dom").isNull() | (F.octet_length("dom") == 0)
    return attempts.groupBy("label").agg(
        F.count("*").alias("attempted"), F.count_if(~failed).alias("completed"),
        F.count_if(failed).alias("failed"))


def union_samples(*parts: DataFrame) -> DataFrame:
    """Every part, duplicates kept."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def union_prototype_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """The sets as one table with their name in ``proto_set``."""
    return union_samples(*[df.withColumn("proto_set", F.lit(name)) for name, df in sets.items()])


def label_counts(samples: DataFrame) -> DataFrame:
    """A3."""
    return samples.groupBy(F.coalesce("label", F.lit(UNKNOWN)).alias("label")).agg(
        F.count("*").alias("samples"))


def dataset_overview(samples: DataFrame, order: str = "idx", examples: int = 10) -> DataFrame:
    """A4/T4: one row with the total, the label counts and the first urls.

    The examples are a distributed top-n; only those rows are gathered."""
    first = samples.orderBy(order).limit(examples).select(order, F.coalesce("url", F.lit("-")).alias("url"))
    urls = first.agg(F.transform(
        F.sort_array(F.collect_list(F.struct(order, "url"))), lambda r: r["url"]).alias("examples"))
    labels = label_counts(samples).agg(
        F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "samples")))).alias("labels"))
    one = F.lit(1).alias("_one")
    return labels.select("*", one).join(urls.select("*", one), "_one").drop("_one")


def build_manifest(samples: DataFrame, meta: DataFrame, key: str = "stem") -> DataFrame:
    """K6: ``dom, meta, label`` of every sample in path order; no metadata means ``unknown``."""
    joined = samples.select(key).join(meta.select(key, "label"), key, "left")
    return joined.select(
        F.concat(key, F.lit(".dom")).alias("dom"), F.concat(key, F.lit(".meta.json")).alias("meta"),
        F.coalesce("label", F.lit(UNKNOWN)).alias("label")).orderBy("dom")


def check_samples(samples: DataFrame, key: str = "doc_id", meta_json: str = "meta_json") -> DataFrame:
    """A5 per sample: its one problem, or ``valid``; ``missing_url`` is a warning beside it.

    ``meta_json`` NULL means there is no metadata file."""
    text = F.col(meta_json)
    is_object = F.try_parse_json(text).isNotNull() & F.coalesce(
        F.json_object_keys(text).isNotNull(), F.lit(False))
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    status = (
        F.when(text.isNull(), "missing_meta").when(~is_object, "invalid_json")
        .when(~F.array_contains(keys, "label"), "missing_label").otherwise("valid"))
    return samples.select(
        key, status.alias("status"),
        F.coalesce(is_object & ~F.array_contains(keys, "url"), F.lit(False)).alias("missing_url"))


def validate_samples(samples: DataFrame, key: str = "doc_id", meta_json: str = "meta_json") -> DataFrame:
    """A5: one row of counts and the verdict; a missing url alone does not invalidate."""
    checked = check_samples(samples, key, meta_json)
    def count(s):
        return F.count_if(F.col("status") == s)
    return checked.agg(
        F.count("*").alias("total"), count("missing_meta").alias("missing_meta"),
        count("missing_label").alias("missing_label"), F.count_if("missing_url").alias("missing_url"),
        count("invalid_json").alias("invalid_json"),
        F.coalesce(F.bool_and(F.col("status") == "valid"), F.lit(True)).alias("valid"))


def problem_examples(samples: DataFrame, status: str, key: str = "doc_id",
                     meta_json: str = "meta_json", n: int = 5) -> DataFrame:
    """A5/T4: the first ``n`` samples with one problem."""
    checked = check_samples(samples, key, meta_json)
    return checked.filter(F.col("status") == status).orderBy(key).limit(n).select(key)
