"""URL expressions: normalizing resource URLs, hosts, domains, sample names."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# URL syntax.
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
BEFORE_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"
SKIPPED_SCHEMES = ["data:", "blob:"]


def _clean(url: Column) -> Column:
    """What URL splitting ignores: leading control characters and blanks, tabs, line breaks."""
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(_clean(url), AUTHORITY, 1)


def url_path(url: Column) -> Column:
    """Path up to ``?`` or ``#``, without the ``;parameters`` of its last segment."""
    path = F.regexp_extract(F.regexp_replace(_clean(url), BEFORE_PATH, ""), r"^[^?#]*", 0)
    return F.regexp_replace(path, r";[^/]*$", "")


def _cut(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)


def _is_fetched(url: Column) -> Column:
    """False for empty and inline references; NULL counts as empty."""
    inline = F.lit(False)
    for scheme in SKIPPED_SCHEMES:
        inline = inline | url.startswith(scheme)
    return F.coalesce((url != "") & ~inline, F.lit(False))


def _host_and_path(url: Column) -> Column:
    host = url_netloc(url)
    return (
        F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(host != "", F.concat(F.replace(host, F.lit("www.")), url_path(url)))
        .otherwise(url_path(url))
    )


def _resolve(ref: str, base: str | None) -> str:
    if not base or ref.startswith("//") or urlsplit(ref).scheme:
        return ref
    return urljoin(base, ref)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolve_all(refs: pd.Series, base: pd.Series) -> pd.Series:
    def one(row_refs, row_base):
        if row_refs is None:
            return None
        out = []
        for ref in row_refs:
            try:
                out.append(_resolve(ref, row_base))
            except ValueError:  # not a URL at all
                out.append("")
        return out

    return pd.Series([one(r, b) for r, b in zip(refs, base)], dtype=object)


def normalize_resource_urls(refs: Column, base: Column | None = None) -> Column:
    """P10 over an array of references, resolved against ``base`` when there is one.

    A reference that is only ``?query`` names the base page itself. Just the joining of
    relative references leaves the JVM, once per array."""
    cut = F.transform(F.filter(refs, _is_fetched), _cut)
    if base is not None:
        cut = _resolve_all(cut, base)
    return F.transform(cut, _host_and_path)


def normalize_resource_url(url: Column, base: Column | None = None) -> Column:
    """P10 for one reference; a dropped reference gives the empty string."""
    return F.coalesce(F.get(normalize_resource_urls(F.array(url), base), F.lit(0)), F.lit(""))


def resource_list(refs: Column, base: Column | None = None) -> Column:
    """The distinct normalized references in code-point order."""
    named = F.filter(normalize_resource_urls(refs, base), lambda u: u != "")
    return F.array_sort(F.array_distinct(named))


def resource_signature(refs: Column, base: Column | None = None) -> Column:
    """The resource list as space-joined bytes."""
    return F.encode(F.array_join(resource_list(refs, base), " "), "UTF-8")


def resource_domains(refs: Column) -> Column:
    """Distinct hosts of the references, ``www.`` removed."""
    hosts = F.filter(F.transform(refs, url_netloc), lambda h: h != "")
    return F.array_sort(F.array_distinct(F.transform(hosts, lambda h: F.replace(h, F.lit("www.")))))


def url_host(url: Column) -> Column:
    """Network location, or the path of a bare name, up to the first colon."""
    netloc = url_netloc(url)
    name = F.when(netloc != "", netloc).otherwise(url_path(url))
    return F.split_part(name, F.lit(":"), F.lit(1))


def url_registrable_domain(url: Column) -> Column:
    """Host without one leading ``www.``."""
    return F.regexp_replace(url_host(url), r"^www\.", "")


def url_to_sample_name(url: Column) -> Column:
    """Domain and path as a file-safe name."""
    domain = F.replace(url_netloc(url), F.lit("www."))
    path = F.replace(F.regexp_replace(url_path(url), r"^/+|/+$", ""), F.lit("/"), F.lit("_"))
    name = F.when(path != "", F.concat_ws("_", domain, path)).otherwise(domain)
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")


def is_http_url(url: Column) -> Column:
    """``http://`` or ``https://``, case-sensitive."""
    return url.startswith("http://") | url.startswith("https://")
