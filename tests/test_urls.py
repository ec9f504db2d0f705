from pyspark.sql import functions as F

from pagesim.functions import urls as U

BASE = "https://www.base.org/dir/page.html?x=1"
#: url, without a base, with ``BASE``, host, sample name: worked out by hand from the rules.
CASES = [
    ("http://user:pw@host.org:8080/x/y.html?q=1#f", "user:pw@host.org:8080/x/y.html", "user:pw@host.org:8080/x/y.html",
     "user", "user_pw_host_org_8080_x_y_html"),
    ("bare.name/x?q", "bare.name/x", "base.org/dir/bare.name/x", "bare.name/x", "_bare_name_x"),
    ("www.foo.com", "www.foo.com", "base.org/dir/www.foo.com", "www.foo.com", "_www_foo_com"),
    ("", "", "", "", ""),
    ("//cdn.www.x/y", "https://cdn.www.x/y", "https://cdn.www.x/y", "cdn.www.x", "cdn_x_y"),
    ("?only", "", "base.org/dir/page.html", "", ""),
    ("https://www.www.q.com/www.html", "q.com/www.html", "q.com/www.html", "www.www.q.com", "q_com_www_html"),
    ("http://x.org", "x.org", "x.org", "x.org", "x_org"),
    ("a/b/../c.js", "a/b/../c.js", "base.org/dir/a/c.js", "a/b/../c.js", "_a_b____c_js"),
    ("../up.png", "../up.png", "base.org/up.png", "../up.png", "____up_png"),
    ("https://d.org/é/ü.html", "d.org/é/ü.html", "d.org/é/ü.html", "d.org", "d_org_é_ü_html"),
    ("http://[::1]:80/x", "[::1]:80/x", "[::1]:80/x", "[", "___1__80_x"),
    ("data:xx", "", "", None, None),
    ("blob:yy", "", "", None, None),
]


def test_against_worked_out_answers(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "u string")
    u = F.col("u")
    rows = df.select(
        "u", U.normalize_resource_url(u).alias("bare"), U.normalize_resource_url(u, F.lit(BASE)).alias("based"),
        U.url_host(u).alias("host"), U.url_to_sample_name(u).alias("name")).collect()
    want = {c[0]: c[1:] for c in CASES}
    for r in rows:
        bare, based, host, name = want[r.u]
        assert (r.bare, r.based) == (bare, based), r.u
        assert host is None or (r.host, r.name) == (host, name), r.u


def test_domains_and_schemes(spark):
    df = spark.createDataFrame([("https://www.www.x.org:1/a",), ("HTTP://x",), ("http://y",)], "u string")
    rows = df.select(U.url_registrable_domain(F.col("u")).alias("d"), U.is_http_url(F.col("u")).alias("h")).collect()
    assert [r.d for r in rows] == ["www.x.org", "x", "y"]
    assert [r.h for r in rows] == [True, False, True]
