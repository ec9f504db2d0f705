"""The inputs the product expects, derived from the driver's tables.

The tables hold no feed, labels or snapshots, so those are read off the data itself (scheme,
host, language, length), always over whole tables. ``oracle.py`` derives the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesim.functions.html import sanitize_tags
from pagesim.functions.urls import url_host, url_registrable_domain
from pagesim.operators.corpus import as_samples
from pagesim.operators.prototypes import build_prototypes, fpf_select
from pagesim.operators.signatures import filter_feed, replace_signatures
from pagesim.session import at_least_partitions, materialize
from pagesim.sources.readers import read_html_pages

# the driver's pages are small, so both sides of every threshold need lower ones
SMALL_DOM = 100
MINIMAL_DOM = 90
K = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_html_pages(spark, f"{sf}/pages.parquet")


def page_label():
    url = F.col("url")
    return F.when(url.startswith("http://"), "phish").otherwise("legit")


def page_set():
    url = F.col("url")
    return (F.when(~url.startswith("http://"), "legit")
            .when(url_host(url).endswith(".com"), "phish_cluster_1").otherwise("phish_cluster_2"))


def labelled_doms(spark: SparkSession, sf: str) -> DataFrame:
    """Every page sanitized, with its class, set and (as the sample order) its id; a stored
    table, as samples are."""
    doms = sanitize_tags(pages(spark, sf)).drop("tags", "parse_error")
    doms = doms.withColumns({"label": page_label(), "proto_set": page_set(), "idx": F.col("page_id")})
    return materialize(doms, "doms")


def prototypes(spark: SparkSession, sf: str, distance: str = "ncd") -> DataFrame:
    """K prototypes per class, selected from all pages."""
    return build_prototypes(labelled_doms(spark, sf), K, minimal_threshold=MINIMAL_DOM,
                            distance=distance, first="lowest")


def cluster_prototypes(spark: SparkSession, sf: str, distance: str = "ncd") -> DataFrame:
    """K prototypes per set, selected from all pages; there is no third phish set."""
    return fpf_select(labelled_doms(spark, sf), K, by="proto_set", distance=distance, first="lowest")


def _stamp(hours):
    moment = F.timestamp_seconds(F.lit(1704067200) + hours * 3600)
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def feed_raw(spark: SparkSession, sf: str) -> DataFrame:
    """One feed row per page: .com hosts are verified, urls with a fragment are offline."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.select(
        F.col("page_id").alias("phish_id"), "url",
        F.concat(F.lit("detail/"), F.col("page_id").cast("string")).alias("phish_detail_url"),
        _stamp(F.col("page_id")).alias("submission_time"),
        F.when(url_host(F.col("url")).endswith(".com"), "yes").otherwise("no").alias("verified"),
        F.lit("").alias("verification_time"),
        F.when(F.col("url").contains("#"), "no").otherwise("yes").alias("online"),
        F.lit("Other").alias("target"), F.col("page_id").alias("input_seq"))


def feed_log(spark: SparkSession, sf: str) -> DataFrame:
    """``feed_raw`` and then one resubmission per event: hot urls, hot ids and collisions on
    both keys."""
    checks = url_checks(spark, sf, ["value", "event_type"])
    again = checks.select(
        (F.lit(1000000) + F.floor("value")).cast("bigint").alias("phish_id"), "url",
        F.concat(F.lit("detail/"), F.col("event_id").cast("string")).alias("phish_detail_url"),
        _stamp(F.col("event_id")).alias("submission_time"),
        F.when(F.col("event_type") == "error", "no").otherwise("yes").alias("verified"),
        F.lit("").alias("verification_time"),
        F.when(F.col("event_type") == "signup", "no").otherwise("yes").alias("online"),
        F.lit("Other").alias("target"), (F.lit(1000000) + F.col("event_id")).alias("input_seq"))
    return feed_raw(spark, sf).unionByName(again)


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """The loaded signature table."""
    return replace_signatures(filter_feed(feed_raw(spark, sf)), updated_at=F.lit("2024-06-01"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The files hold times without a zone; they are UTC."""
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def url_checks(spark: SparkSession, sf: str, extra: list[str] = []) -> DataFrame:
    """One check per event, of the page its user looks at."""
    e = events(spark, sf).select("event_id", "ts", "user_id", *extra)
    p = table(spark, sf, "pages").select(F.col("page_id").alias("user_id"), "url")
    return e.join(p, "user_id").select("event_id", "ts", "url", *extra)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents, whole texts."""
    d = at_least_partitions(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"))
    joined = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return joined.select(
        "doc_id", F.col("doc_id").alias("idx"), "lang",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("quality") == 0, "phish").otherwise("legit").alias("label"),
        F.encode("text", "UTF-8").alias("dom"), F.octet_length("text").cast("bigint").alias("size"))


def samples_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with metadata texts of every kind, by language; one source has none."""
    s = table(spark, sf, "documents").select("doc_id", "lang", "source")
    text = (F.when(F.col("source") == "src7", F.lit(None).cast("string"))
            .when(F.col("lang") == "fr", '{"url": "u"}').when(F.col("lang") == "de", '{"label": "legit"}')
            .when(F.col("lang") == "es", '{"url": ').otherwise('{"url": "u", "label": "legit"}'))
    return s.select("doc_id", text.alias("meta_json"))


def page_samples(spark: SparkSession, sf: str) -> DataFrame:
    doms = labelled_doms(spark, sf)
    return as_samples(doms, F.col("label"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = at_least_partitions(table(spark, sf, "embeddings"))
    return v.select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("dom"),
                    F.col("label").cast("bigint").alias("label"))


def resource_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages with resource elements of every kind put in front of their own markup."""
    p = pages(spark, sf)
    host = url_host(F.col("url"))
    i = F.col("page_id").cast("string")
    head = F.concat(
        F.lit('<script src="/js/app'), i, F.lit('.js?v=1"></script><link rel="stylesheet" href="//cdn.'), host,
        F.lit('/s.css"><img src="https://www.'), host, F.lit('/i/'), i,
        F.lit('.png#x"><img src="data:image/png;base64,AA"><style>a{background:url(\'/bg/'), host,
        F.lit('.gif\')}</style><link rel="dns-prefetch" href="https://ads.example.org"><link rel="icon" href="/f.ico">'
              '<iframe src="https://frame.example.net/x?y=1"></iframe><video src="/v.mp4"></video>'
              '<source src="/v.mp4">'))
    return p.withColumn("html", F.concat(head, "html"))


def snapshots(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    p = table(spark, sf, "pages").select("url").distinct()
    domains = p.select(url_registrable_domain(F.col("url")).alias("domain")).distinct()
    hosts = p.select(url_host(F.col("url")).alias("host")).distinct()
    born = F.timestamp_seconds(F.lit(1420070400) + F.length("domain") * 37 * 86400)
    whois = domains.filter(~F.col("domain").endswith(".org")).select(
        "domain", F.concat(F.lit("R"), F.upper(F.left("domain", F.lit(1)))).alias("registrar"),
        F.array(born, born + F.expr("interval 5 days")).alias("created"),
        F.array(born + F.expr("interval 3650 days")).alias("expires"))
    dns = domains.filter(~F.col("domain").contains("spam")).select(
        "domain", F.array(F.concat(F.lit("ns1."), "domain", F.lit(".")), F.concat(F.lit("ns2."), "domain")).alias("ns"),
        F.when(~F.col("domain").endswith(".net"), F.array(F.concat(F.lit("mx."), "domain", F.lit(".")))).alias("mx"))
    lang = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    query = F.col("url").contains("?")
    certs = p.select(
        "url",
        F.when(query & (lang == "en"), "ssl").when(lang == "fr", "ssl").when(lang == "de", "timeout")
         .when(lang == "es", "ssl").alias("error_kind"),
        F.when(query & (lang == "en"), "[SSL: UNEXPECTED_EOF_WHILE_READING] x")
         .when(lang == "fr", "[SSL: CERTIFICATE_VERIFY_FAILED] x").when(lang == "de", "timed out")
         .when(lang == "es", "[SSL: SSLV3_ALERT_HANDSHAKE_FAILURE] x").alias("error_text"),
        F.lit("Test CA").alias("issuer"), F.lit("Jan  5 09:34:43 2018 GMT").alias("not_before"),
        F.when(F.col("url").contains("#"), "some day").otherwise("Dec 31 23:59:59 2030 GMT").alias("not_after"))
    hosting = hosts.filter(~F.col("host").startswith("blog.")).select(
        "host", F.concat(F.lit("10.0.0."), F.length("host").cast("string")).alias("ip"),
        F.when(~F.col("host").startswith("m."), F.concat(F.lit("ptr."), "host")).alias("ptr"))
    return {"whois": whois, "dns": dns, "certs": certs, "hosting": hosting}


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Click events as feedback on the detection of their own id; other events name ids nobody
    knows."""
    e = events(spark, sf)
    known = F.col("event_type") == "click"
    return e.select(
        F.when(known, F.col("event_id")).otherwise(F.col("event_id") + 1000000000).cast("string").alias("id"),
        F.when(F.col("value") >= 50, "Yes").when(F.col("value") >= 10, "no").otherwise("maybe").alias("correct"),
        (F.col("ts") + F.expr("interval 10 minutes")).alias("ts"))

