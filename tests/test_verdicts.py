import pytest
from pyspark.sql import functions as F

from pagesim.functions import osint as O
from pagesim.functions import verdicts as V


def classify(spark, phish, legit, size, **options):
    df = spark.createDataFrame([(float(phish), float(phish), float(legit), float(legit), b"x" * size)],
                               "phish_min double, phish_avg double, legit_min double, legit_avg double, dom binary")
    return V.classify_scores(df, **options).first()


def test_tie_is_legit(spark):
    row = classify(spark, 0.5, 0.5, 300)
    assert (row.verdict, row.confidence, row.minimal_dom_adjustment_applied) == ("legit", "low", False)
    assert row.final_decision == "Legitimate prototype match (0.5000) better than phishing (0.5000)"


def test_penalty(spark):
    row = classify(spark, 0.5, 0.5, 299)
    assert (row.verdict, row.minimal_dom_adjustment_applied) == ("phish", True)
    assert row.final_decision == (
        "Phishing prototype match (0.5000) better than adjusted legitimate (0.5500, original: 0.5000)")
    assert row.reason == (
        "Classified as phish. Phishing prototype distances: min=0.5000, avg=0.5000. "
        "Legitimate prototype distances: min=0.5000, avg=0.5000. Minimal DOM penalty applied (+0.05). " + row.final_decision)
    kept = classify(spark, 0.7, 0.5, 10)
    assert kept.final_decision == "Legitimate prototype match (0.5500, original: 0.5000) better than phishing (0.7000)"
    assert kept.legit_min == 0.5


def test_no_prototypes(spark):
    row = classify(spark, 0.1, 0.9, 400, has_prototypes=False)
    assert (row.verdict, row.phish_min, row.legit_avg) == ("unknown", 1.0, 1.0) and row.score_error


@pytest.mark.parametrize("gap, band", [(0.2, "high"), (0.08, "medium"), (0.01, "low")])
def test_bands(spark, gap, band):
    assert classify(spark, 0.3, 0.3 + gap, 400).confidence == band
    assert classify(spark, 0.3 + gap, 0.3, 400).confidence == band


def test_modes(spark):
    df = spark.createDataFrame([(1999,), (2000,)], "n int")
    assert [r[0] for r in df.select(V.detection_mode(F.col("n"))).collect()] == ["resource-signature", "dom-structure"]


@pytest.mark.parametrize("p, label, on, expect", [
    (0.59, "phish", "phish", ("legit", "ncd")), (0.60, "phish", "phish", ("phish", "ml")),
    (0.95, "phish", "phish", ("phish", "ml")), (0.05, "legit", "phish", ("legit", "ncd")),
    (0.05, "legit", "max", ("legit", "ml")), (None, None, "phish", (None, "ncd")),
])
def test_hybrid(spark, p, label, on, expect):
    df = spark.createDataFrame([(p, label)], "p double, label string")
    final, source = V.hybrid_decision(F.lit("legit"), F.col("label"), F.col("p"), on=on)
    assert tuple(df.select(final, source).first()) == expect


def test_families_and_labels(spark):
    df = spark.createDataFrame([(v,) for v in ("phish", "phish-cluster-1", "phishy", "suspicious", "legit", "unknown")], "v string")
    assert [r[0] for r in df.select(V.verdict_family(F.col("v"))).collect()] == [
        "phish", "phish", "unknown", "suspicious", "legit", "unknown"]
    assert [tuple(r) for r in df.limit(1).select(V.label_to_int(F.col("v")), V.int_to_label(F.lit(1)), V.int_to_label(F.lit(0))).collect()] == [
        (1, "phish", "legit")]


@pytest.mark.parametrize("url, kind, text, answer", [
    ("http://a", None, None, "HTTP only (no SSL)"), ("https://a", None, None, "CA"),
    ("https://a", "ssl", "UNEXPECTED_EOF", "SSL connection interrupted"),
    ("https://a", "ssl", "x EOF CERTIFICATE_VERIFY_FAILED", "SSL connection interrupted"),
    ("https://a", "ssl", "CERTIFICATE_VERIFY_FAILED", "Certificate verification failed"),
    ("https://a", "ssl", "BAD_HANDSHAKE", "SSL handshake failed"), ("https://a", "ssl", "TIMEOUT", "SSL connection timeout"),
    ("https://a", "ssl", "CONNECTION_X", "SSL connection error"), ("https://a", "ssl", "odd", "SSL error (certificate unavailable)"),
    ("https://a", "timeout", "", "Connection timeout"), ("https://a", "dns", "", "DNS resolution failed"),
    ("https://a", "refused", "", "Connection refused"), ("https://a", "other", "", "Certificate unavailable"),
])
def test_certificate_answers(spark, url, kind, text, answer):
    df = spark.createDataFrame([(url, kind, text, "CA")], "u string, k string, t string, i string")
    assert df.select(O.cert_probe_status(F.col("u"), F.col("k"), F.col("t"), F.col("i"))).first()[0] == answer


def test_dates_and_names(spark):
    df = spark.sql("SELECT 'Jan  5 09:34:43 2018 GMT' AS a, 'soon' AS b, array('x.', 'y') AS n, cast(NULL AS array<string>) AS m,"
                   " array(timestamp'2024-01-01 12:00:00', timestamp'2020-01-01') AS c, timestamp'2024-01-03 11:59:59' AS t")
    row = df.select(O.cert_date(F.col("a")).alias("a"), O.cert_date(F.col("b")).alias("b"), O.dns_names(F.col("n"), []).alias("n"),
                    O.dns_names(F.col("m"), ["none"]).alias("m"), O.domain_age_days(F.col("c"), F.col("t")).alias("d")).first()
    assert (row.a, row.b, row.n, row.m, row.d) == ("2018-01-05", "soon", ["x", "y"], ["none"], 1)
    ptr = spark.createDataFrame([(None, None), ("1.1.1.1", None), ("1.1.1.1", "h")], "ip string, p string")
    assert [r[0] for r in ptr.select(O.ptr_status(F.col("ip"), F.col("p"))).collect()] == ["unknown", "no PTR record", "h"]
