import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagesim.fixed_values import FEATURES, SIMILARITY_FEATURES
from pagesim.operators import features as X

from . import brute


def features(spark, pages, protos=None, **options):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [r.asDict() for r in X.page_features(df, protos, **options).orderBy("page_id").collect()]


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def test_empty_pages(spark):
    for row in features(spark, ["", None]):
        assert all(row[f] == (1.0 if f in SIMILARITY_FEATURES else 0.0) for f in FEATURES)


def test_counts(spark):
    form = features(spark, ["<form><input><input><button>b</button></form>"])[0]
    assert (form["count_form"], form["count_input"], form["ratio_interactive_tags"]) == (1.0, 2.0, 1.0)
    tags = features(spark, ["<meta><link><script></script><img><iframe></iframe>"])[0]
    assert all(tags[f"count_{t}"] == 1.0 for t in ("meta", "link", "script", "img", "iframe"))
    page = features(spark, ["<html><head><title>x</title></head><body><p>é</p></body></html>"])[0]
    assert (page["total_tag_count"], page["unique_tag_count"], page["depth_of_dom_tree"]) == (5.0, 5.0, 3.0)
    assert page["dom_length_bytes"] == len("<html><head><title>x</title></head><body><p>é</p></body></html>".encode())
    assert page["average_children_per_node"] == 1.0 and page["dom_token_count"] == 5.0


def test_text_without_tags(spark):
    row = features(spark, ["plain"])[0]
    assert (row["total_tag_count"], row["dom_entropy"], row["average_children_per_node"]) == (0.0, 0.0, 0.0)
    assert row["dom_length_bytes"] == 5.0


@pytest.mark.parametrize("text", ["abcabcabc", "aaaaaa", "", "html head body p p", "größe ß", ".*a+[b]"])
def test_entropy_and_frequencies(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert df.select(X.shannon_entropy(F.col("t"))).first()[0] == pytest.approx(entropy(text))
    counts = {r.character: r.occurrences for r in X.char_frequency(df, "k", "t").collect()}
    assert counts == dict(Counter(text))


def test_similarity_features(spark):
    protos = brute.tag_texts(7, 20)
    names = ["phish_cluster_1", "phish_cluster_1", "phish_cluster_2", "legit", "legit", "legit", "phish_cluster_2"]
    sets = spark.createDataFrame([(n, i, d) for i, (n, d) in enumerate(zip(names, protos))],
                                 "proto_set string, prototype_index int, dom binary")
    pages = ["<p>x</p>", "<html><body><div><a href='x'>y</a></div></body></html>", ""]
    rows = features(spark, pages, sets)
    for page, row in zip(pages[:2], rows):
        for name in ("phish_cluster_1", "phish_cluster_2", "legit"):
            ds = [brute.ncd(page.encode(), p) for n, p in zip(names, protos) if n == name]
            assert row[f"ncd_{name}_min"] == pytest.approx(min(ds))
            assert row[f"ncd_{name}_avg"] == pytest.approx(sum(ds) / len(ds))
        assert row["ncd_phish_cluster_3_min"] == 1.0
        assert row["ncd_phish_best"] == min(row[f"ncd_phish_cluster_{i}_min"] for i in (1, 2, 3))
        assert row["ncd_phish_avg"] == pytest.approx(sum(row[f"ncd_phish_cluster_{i}_avg"] for i in (1, 2, 3)) / 3)
    assert rows[2]["ncd_legit_min"] == 1.0
