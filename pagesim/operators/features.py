"""The 25 page features as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SIMILARITY_FEATURES
from ..functions.html import html_tokens
from .scores import cluster_scores

# Tags counted one by one, and tags a visitor acts on.
COUNTED_TAGS = ["form", "input", "script", "img", "iframe", "link", "meta"]
INTERACTIVE_TAGS = ["form", "input", "button"]


def _count(tags: Column, name: str) -> Column:
    return F.size(F.filter(tags, lambda t: t == name)).cast("double")


def tag_features(tags: Column, depth: Column) -> dict[str, Column]:
    """F1-F11. The average of children per node is 1.0 for any page with a tag."""
    total = F.size(tags).cast("double")
    out = {
        "total_tag_count": total,
        "unique_tag_count": F.size(F.array_distinct(tags)).cast("double"),
        "depth_of_dom_tree": depth.cast("double"),
        "average_children_per_node": F.when(total > 0, 1.0).otherwise(0.0),
    }
    out.update({f"count_{name}": _count(tags, name) for name in COUNTED_TAGS})
    return out


def shannon_entropy(text: Column) -> Column:
    """Base-2 entropy of the characters of ``text``."""
    length = F.length(text).cast("double")
    characters = F.array_distinct(F.split(text, ""))
    shares = F.transform(
        F.filter(characters, lambda c: c != ""),
        lambda c: (F.length(text) - F.length(F.replace(text, c))) / length)
    bits = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(length > 0, bits).otherwise(0.0)


def structure_features(tags: Column, html_bytes: Column) -> dict[str, Column]:
    """F12-F15."""
    total = F.size(tags)
    interactive = F.size(F.filter(tags, lambda t: t.isin(INTERACTIVE_TAGS)))
    return {
        "dom_entropy": shannon_entropy(F.array_join(tags, " ")),
        "dom_token_count": total.cast("double"),
        "dom_length_bytes": html_bytes.cast("double"),
        "ratio_interactive_tags": F.when(total > 0, interactive / total).otherwise(0.0),
    }


def char_frequency(texts: DataFrame, key: str, text: str) -> DataFrame:
    """A18 in long form: occurrences of every character of every text."""
    return (
        texts.select(key, F.explode(F.split(text, "")).alias("character"))
        .filter(F.col("character") != "")
        .groupBy(key, "character").agg(F.count("*").alias("occurrences"))
    )


def page_features(pages: DataFrame, cluster_protos: DataFrame | None = None, html: str = "html",
                  distance: str = "ncd", key: str = "page_id", payload: str | None = None,
                  keep_html: bool = False, **options) -> DataFrame:
    """F1-F25 of every page. Without ``cluster_protos`` the similarity features are 1.0, as
    they are for an empty page.

    The similarity features measure the whole page text (or ``payload``) against the sets."""
    empty = F.coalesce(F.length(html), F.lit(0)) == 0
    read = html_tokens(
        pages.withColumn("_bytes", F.octet_length(html)).withColumn("_empty", empty),
        ["all_tags", "depth"], html, keep_html=True)
    tags = F.coalesce("all_tags", F.array().cast("array<string>"))
    depth = F.coalesce("depth", F.lit(0))
    out = read.withColumns({**tag_features(tags, depth),
                            **structure_features(tags, F.coalesce("_bytes", F.lit(0)))})
    out = out.drop("all_tags", "depth", "_bytes")
    if cluster_protos is None:
        out = out.withColumns({f: F.lit(1.0) for f in SIMILARITY_FEATURES})
    else:
        out = out.withColumn("_payload", F.when(
            ~F.col("_empty"), F.col(payload) if payload else F.encode(html, "UTF-8")))
        out = cluster_scores(out, cluster_protos, key=key, payload="_payload", distance=distance, **options)
        out = out.withColumns({f: F.coalesce(f, F.lit(1.0)) for f in SIMILARITY_FEATURES})
        out = out.drop("_payload")
    out = out.drop("_empty")
    return out if keep_html else out.drop(html)

