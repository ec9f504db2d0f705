"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .html import read_page


@F.udtf(returnType="position: int, tag: string", useArrow=True)
class PageTokens:
    """``page_tokens(html)``: the sanitized tags of one page, in order.

    No rows for a missing or empty page, and none for one that fails to parse."""

    def eval(self, html):
        if not html:
            return
        try:
            tags = read_page(html)["tags"]
        except Exception:  # as in the parser engine, one bad page must not fail the query
            return
        yield from enumerate(tags)


def register_page_functions(spark: SparkSession) -> None:
    """``page_tokens`` for ``LATERAL`` in SQL."""
    spark.udtf.register("page_tokens", PageTokens)
