import pytest
from pyspark.sql import functions as F

from pagesim.operators import enrich as E
from pagesim.operators import feedback as B
from pagesim.plans.detect import classify_pages, detect, redetect

from . import brute

LONG = "<html><body>" + "<div><p>x</p></div>" * 250 + "</body></html>"
PAGES = [("https://a.org/", "<html><body><div><p>x</p><a href='y'>z</a></div></body></html>"),
         ("https://b.org/", "<html><script src='/app.js'></script><img src='https://www.cdn.org/i.png?x=1'></html>"),
         ("https://c.org/", LONG), ("https://d.org/", ""), ("https://e.org/", "no tags")]


@pytest.fixture(scope="module")
def data(spark):
    protos = brute.tag_texts(6, 30)
    p = spark.createDataFrame([("phish" if i < 3 else "legit", i, d) for i, d in enumerate(protos)],
                              "label string, prototype_index int, dom binary")
    pages = spark.createDataFrame(PAGES, "url string, html string")
    feed = spark.createDataFrame([(9, "https://f.org/", "t", "T")], "phish_id long, url string, submission_time string, target string")
    return protos, p, pages, feed


def scores(data, protos):
    phish, legit = [brute.ncd(data, p) for p in protos[:3]], [brute.ncd(data, p) for p in protos[3:]]
    return [min(phish), sum(phish) / 3, min(legit), sum(legit) / 3]


def test_classify_pages(spark, data):
    protos, p, pages, _ = data
    rows = {r.url: r for r in classify_pages(pages, p).collect()}
    dom_c = b"html body" + b" div p" * 250
    assert len(dom_c) < 2000 and rows["https://c.org/"].detection_mode == "resource-signature"
    sig = b"b.org/app.js cdn.org/i.png"
    b = rows["https://b.org/"]
    assert b.dom_size == b.resource_sig_length == len(sig) and b.minimal_dom_adjustment_applied
    expect = scores(sig, protos)
    assert [b.phish_min, b.phish_avg, b.legit_min, b.legit_avg] == pytest.approx(expect, abs=1e-4)
    assert b.verdict == ("phish" if expect[0] < expect[2] + 0.05 else "legit")
    a = rows["https://a.org/"]
    assert a.resource_sig_length == 0 and a.phish_min == pytest.approx(scores(b"", protos)[0], abs=1e-4)
    assert rows["https://d.org/"].error and rows["https://e.org/"].error


def test_dom_mode(spark, data):
    protos, p, pages, _ = data
    row = classify_pages(pages.filter("url = 'https://c.org/'"), p, small_dom_threshold=100).first()
    dom = b"html body" + b" div p" * 250
    assert (row.detection_mode, row.dom_size, row.resource_sig_length) == ("dom-structure", len(dom), None)
    assert row.minimal_dom_adjustment_applied is False
    assert row.legit_avg == pytest.approx(scores(dom, protos)[3], abs=1e-4)


def test_detect(spark, data):
    _, p, pages, feed = data
    urls = ["https://f.org/"] * 2 + ["https://a.org/"] * 5 + ["https://d.org/", "https://zz.org/", "https://b.org/"]
    checks = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    rows = detect(checks, pages, feed, p).orderBy("id").collect()
    assert [r.source for r in rows] == ["signature-local"] * 2 + ["ncd"] * 5 + ["error", "error", "ncd"]
    assert rows[0].classification == "phish" and rows[0].confidence == "high" and rows[0].prototype_scores is None
    assert (rows[7].classification, rows[7].confidence) == ("unknown", "low")
    assert len({r.detection_id for r in rows if r.detection_id}) == 6
    assert rows[0].detection_id is None and len({r.classification for r in rows[2:7]}) == 1
    skipped = detect(checks, pages, feed, p, skip_ncd=True).orderBy("id").collect()
    assert [(r.classification, r.confidence) for r in skipped[1:3]] == [("phish", "high"), ("legit", "medium")]
    assert skipped[2].message and skipped[0].message is None


def test_parse_first_gives_the_same(spark, data):
    _, p, pages, feed = data
    checks = pages.select("url").unionByName(pages.select("url"))
    one, two = (detect(checks, pages, feed, p, detection_id=F.lit(1), parse_first=first).drop("detected_at").orderBy("url").collect()
                for first in (False, True))
    assert one == two


def test_checks_that_carry_their_page(spark, data):
    _, p, pages, feed = data
    known = pages.unionByName(spark.createDataFrame([("https://f.org/", "<p>a hit</p>")], "url string, html string"))
    carried = known.withColumn("id", F.monotonically_increasing_id())
    plain = detect(carried.drop("html"), known, feed, p, detection_id=F.lit(1)).drop("detected_at")
    own = detect(carried, None, feed, p, detection_id=F.lit(1)).drop("detected_at")
    assert own.select(*plain.columns).orderBy("url").collect() == plain.orderBy("url").collect()
    changed = spark.createDataFrame([("https://a.org/", "<p>x</p>"), ("https://a.org/", LONG)], "url string, html string")
    rows = detect(changed, None, feed, p, small_dom_threshold=1).collect()
    assert len({r.dom_size for r in rows}) == 2  # each check is judged by the page it carries


def test_hot_url_is_measured_once(spark, data):
    _, p, pages, feed = data
    checks = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "https://a.org/").otherwise("https://b.org/").alias("url"))
    out = detect(checks, pages, feed, p, detection_id=F.col("id"))
    assert out.count() == 3000 and out.groupBy("url").agg(F.countDistinct("reason").alias("n")).agg(F.max("n")).first()[0] == 1


def test_skip_signature_and_no_prototypes(spark, data):
    _, p, pages, feed = data
    checks = spark.createDataFrame([("https://f.org/",), ("https://a.org/",)], "url string")
    rows = {r.url: r for r in detect(checks, pages, feed, p, skip_signature=True).collect()}
    assert rows["https://f.org/"].source == "error" and rows["https://a.org/"].source == "ncd"
    rows = {r.url: r for r in detect(checks, pages, feed, p.limit(0)).collect()}
    assert rows["https://a.org/"].classification == "unknown" and rows["https://a.org/"].error


def test_unverified_feed_rows(spark, data):
    _, p, pages, _ = data
    feed = spark.createDataFrame([(1, "https://a.org/", 0, "t", "T"), (2, "https://b.org/", 1, "t", "T")],
                                 "phish_id long, url string, verified int, submission_time string, target string")
    checks = pages.select("url")
    rows = {r.url: r for r in detect(checks, pages, feed, p, legacy_unverified=True).collect()}
    a = rows["https://a.org/"]
    assert (a.classification, a.confidence, a.source) == ("suspicious", "medium", "phishtank_unverified")
    assert a.similarity.classification in ("phish", "legit")
    assert rows["https://b.org/"].classification == "phish" and rows["https://c.org/"].similarity is None


def test_enrichment(spark):
    ts = "timestamp'2024-01-01'"
    whois = spark.sql(f"SELECT 'a.org' AS domain, 'R' AS registrar, array({ts}) AS created, array({ts}) AS expires")
    dns = spark.sql("SELECT 'a.org' AS domain, array('ns.') AS ns, cast(NULL AS array<string>) AS mx")
    certs = spark.sql("SELECT 'https://www.a.org/' AS url, cast(NULL AS string) AS error_kind, cast(NULL AS string) AS error_text,"
                      " 'CA' AS issuer, 'Jan  5 09:34:43 2018 GMT' AS not_before, 'x' AS not_after")
    hosting = spark.sql("SELECT 'www.a.org' AS host, '1.1.1.1' AS ip, cast(NULL AS string) AS ptr")
    checks = spark.createDataFrame([("https://www.a.org/",), ("http://q.com/",), ("https://q.com/",)], "url string")
    out = E.enrich_domain(checks, whois, dns, certs, hosting, F.lit("2024-01-11").cast("timestamp"))
    rows = {r.url: r for r in out.collect()}
    a = rows["https://www.a.org/"]
    assert (a.registrar, a.domain_age_days, a.nameservers, a.mx_records) == ("R", 10, ["ns"], ["none"])
    assert (a.ssl_enabled, a.ssl_issuer, a.ssl_valid_from, a.ssl_valid_to) == (True, "CA", "2018-01-05", "x")
    assert (a.ip, a.hosting_reverse_dns) == ("1.1.1.1", "no PTR record")
    q = rows["http://q.com/"]
    assert (q.registrar, q.domain_age_days, q.nameservers, q.mx_records, q.ip) == ("unknown", None, [], [], None)
    assert (q.ssl_enabled, q.ssl_issuer) == (False, "HTTP only (no SSL)")
    assert rows["https://q.com/"].ssl_issuer == "unknown"


def test_feedback(spark):
    f = spark.createDataFrame([("1", "YES"), ("1", "maybe"), ("7", "no"), ("2", None)], "id string, correct string").withColumn(
        "ts", F.current_timestamp())
    d = spark.createDataFrame([("1", "u", "legit"), ("2", "v", "phish")], "detection_id string, url string, verdict string").withColumn(
        "detected_at", F.current_timestamp())
    assert [(r.id, r.verdict, r.user_feedback) for r in B.join_feedback(f, d).collect()] == [("1", "legit", "yes")]
    assert sorted((r.id, r.status) for r in B.reject_feedback(f, d).collect()) == [("1", 400), ("2", 400), ("7", 404)]


def test_carried_pages_beyond_the_bound(spark, data):
    """Two checks of one url with different pages keep their own answers."""
    _, p, pages, feed = data
    html = {r.url: r.html for r in pages.collect()}
    checks = spark.createDataFrame([(1, "https://a.org/", html["https://c.org/"]), (2, "https://a.org/", html["https://b.org/"]),
                                    (3, "https://a.org/", html["https://b.org/"])], "id int, url string, html string")
    one, two = ({r.id: (r.classification, r.prototype_scores) for r in detect(
        checks, None, feed, p, small_dom_threshold=100, **bound).collect()} for bound in ({}, {"max_rows": 1}))
    assert two[2] == two[3] != two[1] and set(one) == {1, 2, 3}
    for k in one:
        assert one[k][0] == two[k][0] and list(two[k][1]) == pytest.approx(list(one[k][1]), abs=1e-3)


def test_repeated_feed_and_page_rows_add_no_answers(spark, data):
    _, p, pages, feed = data
    checks = spark.createDataFrame([(1, "https://f.org/"), (2, "https://a.org/"), (3, None)], "id int, url string")
    more = feed.withColumn("phish_id", F.lit(4).cast("long"))
    rows = {r.id: r for r in detect(checks, pages.unionAll(pages), feed.unionAll(more), p).collect()}
    assert len(rows) == 3 and rows[1].phish_id == 4 and rows[2].source == "ncd" and rows[3].source == "error"


def test_a_hot_url_is_split_in_the_one_join_of_the_raw_checks(spark, data, tmp_path):
    _, p, pages, feed = data
    hot = spark.range(60_000).select("id", F.when(F.col("id") % 10 < 9, "https://a.org/").otherwise(
        F.concat(F.lit("https://x.org/"), F.col("id"))).alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("pad"))
    hot.write.parquet(str(tmp_path / "checks"))
    checks = spark.read.parquet(str(tmp_path / "checks"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = detect(checks, pages, feed, p, detection_id=F.col("id"))
        assert len(out.collect()) == 60_000
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    final = plan.split("== Initial Plan ==")[0]
    assert "skew=true" in final and final.count("MapInArrow") == 1
    assert not any("html" in line for line in final.split("\n") if "Exchange" in line)


def test_callers_columns_of_any_name_pass_through(spark, data):
    """Names that the plan uses itself; those of answers give way to the answers."""
    _, p, pages, feed = data
    names = ["verdict", "phish_id", "_read", "_hash", "error", "html", "_check", "dom_length", "features", "in_database", "classified",
             "detection_mode", "_unverified_id", "ncd_error", "final_verdict", "phish_min", "tags", "label", "_d", "confidence", "a b"]
    plain = spark.createDataFrame([(1, "https://f.org/"), (2, "https://a.org/"), (3, "https://none.org/")], "id int, url string")
    checks = plain.withColumns({n: F.concat(F.lit(n), F.col("id")) for n in names})
    want = {r.id: r for r in detect(plain, pages, feed, p, detection_id=F.col("id")).collect()}
    got = {r.id: r for r in detect(checks, pages, feed, p, detection_id=F.col("id")).collect()}
    for k, row in want.items():
        ours, theirs = got[k].asDict(), row.asDict()
        assert {c: ours[c] for c in theirs if c != "detected_at"} == {c: theirs[c] for c in theirs if c != "detected_at"}
        assert all(ours[n] == f"{n}{k}" for n in names if n not in theirs)
    carried = detect(checks.drop("html").join(pages, "url"), None, feed, p, detection_id=F.col("id")).collect()
    assert {r.id: r.classification for r in carried} == {k: r.classification for k, r in want.items() if k in {x.id for x in carried}}
    assert {r["a b"] for r in detect(checks, pages, feed, p, skip_ncd=True).collect()} == {"a b1", "a b2", "a b3"}


def test_only_checks_of_changed_entries_are_judged_again(spark, data):
    _, p, pages, feed = data
    checks = spark.createDataFrame([(i, u) for i, u in enumerate(["https://f.org/", "https://a.org/", "https://b.org/", "https://a.org/"])], "event_id int, url string")
    new = spark.createDataFrame([(7, "https://b.org/", "t", "T")], "phish_id long, url string, submission_time string, target string")

    def answer(some, version):
        return detect(some, pages, version, p, detection_id=F.col("event_id")).select("event_id", "url", "classification", "source", "phish_id")

    out, judged = redetect(checks, answer(checks, feed), feed, new, answer)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, answer(checks, new).collect()))
    assert {r.url for r in judged.collect()} == {"https://f.org/", "https://b.org/"}
