"""Joining detections with domain, certificate and hosting snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import UNKNOWN
from ..functions.osint import (
    cert_date, cert_probe_status, dns_names, domain_age_days, first_date, ptr_status, ssl_enabled,
)
from ..functions.urls import url_host, url_registrable_domain


def enrich_domain(checks: DataFrame, whois: DataFrame, dns: DataFrame, certs: DataFrame,
                  hosting: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Four left joins on domain, url and host; a missing snapshot gives the defaults.

    Snapshots: ``whois(domain, registrar, created array<timestamp>, expires array<timestamp>)``,
    ``dns(domain, ns array, mx array)`` (NULL array: the lookup failed),
    ``certs(url, error_kind, error_text, issuer, not_before, not_after)``,
    ``hosting(host, ip, ptr)``. The narrow url columns are joined per distinct url first, so a
    url checked a billion times meets each snapshot once. Of repeated snapshot rows of a domain,
    url or host one counts, the greatest by content hash."""
    as_of = F.current_timestamp() if as_of is None else as_of
    known = checks.select("url").distinct().withColumns({
        "_domain": url_registrable_domain(F.col("url")), "_host": url_host(F.col("url"))})
    def one(snapshot: DataFrame, key: str) -> DataFrame:
        rest = [c for c in snapshot.columns if c != key]
        row = F.max_by(F.struct(*rest), F.xxhash64(*rest)).alias("_s")
        return snapshot.groupBy(key).agg(row).select(key, "_s.*")

    whois, dns, certs, hosting = one(whois, "domain"), one(dns, "domain"), one(certs, "url"), one(hosting, "host")
    joined = (
        known.join(whois.withColumnRenamed("domain", "_domain"), "_domain", "left")
        .join(dns.withColumnRenamed("domain", "_domain").withColumn("_has_dns", F.lit(True)), "_domain", "left")
        .join(certs.withColumn("_has_cert", F.lit(True)), "url", "left")
        .join(hosting.withColumnRenamed("host", "_host"), "_host", "left")
    )
    https = F.col("url").startswith("https://")
    probed = F.col("_has_cert").isNotNull()
    ok = ssl_enabled(F.col("url"), F.col("error_kind")) & probed
    def when_ok(text):
        return F.when(ok, F.coalesce(cert_date(F.col(text)), F.lit(UNKNOWN))).otherwise(UNKNOWN)
    facts = joined.select(
        "url", "ip", F.when(F.col("ip").isNotNull(), ptr_status(F.col("ip"), F.col("ptr"))).alias("hosting_reverse_dns"),
        F.coalesce("registrar", F.lit(UNKNOWN)).alias("registrar"),
        domain_age_days(F.col("created"), as_of).alias("domain_age_days"),
        first_date(F.col("created")).alias("domain_created"),
        first_date(F.col("expires")).alias("domain_expires"),
        dns_names(F.col("ns"), []).alias("nameservers"),
        F.when(F.col("_has_dns"), dns_names(F.col("mx"), ["none"]))
         .otherwise(F.array().cast("array<string>")).alias("mx_records"),
        F.coalesce(ok, F.lit(False)).alias("ssl_enabled"),
        F.when(~https | probed, cert_probe_status(
            F.col("url"), F.col("error_kind"), F.col("error_text"), F.col("issuer")))
         .otherwise(UNKNOWN).alias("ssl_issuer"),
        when_ok("not_before").alias("ssl_valid_from"), when_ok("not_after").alias("ssl_valid_to"),
    )
    return checks.join(facts, "url", "left")
