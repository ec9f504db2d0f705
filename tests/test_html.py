import pytest
from pyspark.sql import functions as F

from pagesim.functions import html as H
from pagesim.functions import urls as U


def parse(spark, pages, fields):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return [r.asDict() for r in H.html_tokens(df, fields).orderBy("id").collect()]


def one(spark, page, field):
    return parse(spark, [page], [field])[0][field]


@pytest.mark.parametrize("page, depth, tags", [
    ("<html><head><title>t</title></head><body><p>x</p></body></html>", 3, 5),
    ("<div><div><div><p>Deep</p></div></div></div>", 4, 4),
    ("<p>a<p>b", 2, 2),
    ("a</div><b>x</b>", 1, 1),
    ("<div><br><br><i>x</i></div>", 2, 4),
    ("<div/><p>x</p>", 1, 2),
    ("<a><b><c></a><d></d>", 3, 4),
])
def test_nesting(spark, page, depth, tags):
    row = parse(spark, [page], ["depth", "all_tags"])[0]
    assert (row["depth"], len(row["all_tags"])) == (depth, tags)


def test_removed_subtrees(spark):
    page = "<div><script>var a='<p>';</script><noscript><img src=x><b>n</b></noscript><style>p{}</style><SPAN>k</SPAN></div>"
    assert one(spark, page, "tags") == ["div", "span"]
    assert one(spark, page, "all_tags") == ["div", "script", "noscript", "img", "b", "style", "span"]


def test_attributes_in_source_order_once(spark):
    page = '<div id="a" class="b" id="c"><p>x</p><a href></a></div>'
    assert one(spark, page, "tag_attrs") == ["div:id", "div:class", "p", "a:href"]


def test_bad_and_empty_pages_do_not_fail(spark):
    rows = parse(spark, ["<invalid><unclosed>", "", None, "<![x", "<script>never closed <p>"], ["tags", "depth"])
    assert rows[0]["tags"] == ["invalid", "unclosed"]
    assert rows[1]["tags"] is None and rows[2]["tags"] is None
    assert rows[4]["tags"] == []


def test_sanitize_modes(spark):
    df = spark.createDataFrame([("<p class='x'>a</p>",), ("",), ("text",)], "html string")
    assert [r.dom for r in H.sanitize(df, "tags_only").collect()] == [b"p", None, b""]
    assert [r.dom for r in H.sanitize(df, "tags_attrs").collect()] == [b"p:class", None, b""]
    with pytest.raises(ValueError):
        H.sanitize(df, "text")
    with pytest.raises(ValueError):
        H.html_tokens(df, ["nope"])


def test_native_agrees_on_well_formed_pages(spark):
    pages = [
        "<html><head><script>a<b</script><style>p{}</style></head><body><!-- <i> --><div><br><P>x</P></div></body></html>",
        "<ul><li>1</li><li>2<ul><li>3</li></ul></li></ul>", "<p>a<p>b</p></p><hr><b>c</b>",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    fields = ["tags", "all_tags", "depth"]
    native = H.html_tokens(df, fields, engine="native").select(*fields).collect()
    assert native == H.html_tokens(df, fields).select(*fields).collect()


RESOURCES = """<script src="/a.js?v=1"></script><script>inline</script><link rel="stylesheet" href="//cdn/x.css">
<link rel="icon" href="/f.ico"><link rel="preload alternate" href="../p.woff"><link rel="dns-prefetch" href="https://www.ads.org/">
<img src="data:image/png;base64,AA"><img src="https://www.b.org/i.png#x"><style>a{background:url('/bg.gif')}</style>
<iframe src="f.html"></iframe><video src="/v.mp4"></video><audio src="/s.mp3"></audio><source src="/v.mp4"><img src="">"""


def test_native_reads_attributes_references_and_events(spark):
    """All fields equal the parser's: quoted angle brackets, repeated and empty attributes, entities, self-closing tags."""
    pages = [RESOURCES, "<div data-x='a > b' CLASS=\"c\" class=d id><img src='/a?x=1&amp;y=2' alt=\"<p>\"/><br/>t</div>",
             "<a href=/x>1</a><a title = 'say \"hi\"' href>2</a><p>", "<div><noscript><img src=n.png></noscript><script src=s.js>'<i>'</script></div>",
             "<ul><li>a<b>c</ul><span/><hr><P Class=x>y</P></i>", "<style media=all>a{background:url(one.gif)} b{background:url('two.gif')}</style><link rel='a  stylesheet' href=z.css>"]
    df = spark.createDataFrame([(p,) for p in pages] + [("",), (None,)], "html string")
    fields = list(H.PAGE_FIELDS)
    native = H.html_tokens(df, fields, engine="native").select(*fields).collect()
    parsed = H.html_tokens(df, fields).select(*fields).collect()
    for mine, theirs, page in zip(native, parsed, pages + ["", None]):
        for f in fields:
            assert mine[f] == theirs[f], (f, page)


def test_resources(spark):
    df = spark.createDataFrame([(RESOURCES, "https://www.b.org/d/page.html")], "html string, url string")
    read = H.html_tokens(df, ["refs", "domain_refs"])
    row = read.select(
        U.resource_list(F.col("refs"), F.col("url")).alias("joined"), U.resource_list(F.col("refs")).alias("bare"),
        U.resource_domains(F.col("domain_refs")).alias("domains")).first()
    assert row.joined == sorted([
        "b.org/a.js", "https://cdn/x.css", "b.org/p.woff", "ads.org/", "b.org/i.png", "b.org/bg.gif",
        "b.org/d/f.html", "b.org/v.mp4", "b.org/s.mp3"])
    assert row.bare == sorted([
        "/a.js", "https://cdn/x.css", "../p.woff", "ads.org/", "b.org/i.png", "/bg.gif", "f.html", "/v.mp4", "/s.mp3"])
    assert row.domains == ["ads.org", "b.org", "cdn"]


def test_page_is_parsed_once(spark):
    df = spark.createDataFrame([("<p>x</p>",)], "html string")
    out = H.html_tokens(df, ["tags", "depth"]).filter(F.size("tags") > 0).withColumn("n", F.size("tags"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
