"""Domain, certificate and hosting expressions over snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    HTTP_ONLY, NO_PTR, PROBE_MESSAGES, PROBE_OTHER, SSL_MESSAGES, SSL_OTHER, UNKNOWN,
)


def cert_probe_status(url: Column, error_kind: Column, error_text: Column, issuer: Column) -> Column:
    """Issuer column of one probe; ``error_kind`` is ssl, timeout, dns, refused or other."""
    message = F.when(~url.startswith("https://"), HTTP_ONLY)
    for keyword, answer in SSL_MESSAGES:
        message = message.when((error_kind == "ssl") & error_text.contains(keyword), answer)
    message = message.when(error_kind == "ssl", SSL_OTHER)
    for kind, answer in PROBE_MESSAGES.items():
        message = message.when(error_kind == kind, answer)
    return message.when(error_kind.isNotNull(), PROBE_OTHER).otherwise(F.coalesce(issuer, F.lit(UNKNOWN)))


def ssl_enabled(url: Column, error_kind: Column) -> Column:
    return url.startswith("https://") & error_kind.isNull()


def cert_date(text: Column) -> Column:
    """``Jan  5 09:34:43 2018 GMT`` as yyyy-MM-dd; text that is no such date stays."""
    squeezed = F.regexp_replace(text, r" +", " ")
    moment = F.try_to_timestamp(squeezed, F.lit("MMM d HH:mm:ss yyyy z"))
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd"), text)


def domain_age_days(created: Column, as_of: Column) -> Column:
    """Whole days since the first creation date, rounding down."""
    first = F.get(created, F.lit(0))
    return F.floor((F.unix_micros(as_of) - F.unix_micros(first)) / F.lit(86_400_000_000)).cast("int")


def first_date(dates: Column) -> Column:
    """The first of several dates."""
    return F.to_date(F.get(dates, F.lit(0)))


def dns_names(names: Column, when_missing: list[str]) -> Column:
    """Names without trailing dots; a failed lookup (NULL) gives ``when_missing``."""
    default = F.array(*[F.lit(n) for n in when_missing]).cast("array<string>")
    return F.coalesce(F.transform(names, lambda n: F.regexp_replace(n, r"\.+$", "")), default)


def ptr_status(ip: Column, ptr: Column) -> Column:
    """P30."""
    return F.when(ip.isNull() | (ip == ""), UNKNOWN).otherwise(F.coalesce(ptr, F.lit(NO_PTR)))
