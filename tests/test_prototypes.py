import pytest
from pyspark.sql import functions as F

from pagesim.operators import prototypes as P

from . import brute


def samples(spark, items, label=lambda i: "phish"):
    return spark.createDataFrame([(i, label(i), f"u{i}", d) for i, d in enumerate(items)],
                                 "idx long, label string, url string, dom binary")


@pytest.mark.parametrize("every", [2, 100])
def test_fpf_equals_matrix(spark, every):
    items = brute.tag_texts(20, 5)
    got = P.fpf_select(samples(spark, items), 6, first=3, checkpoint_every=every).orderBy("prototype_index").collect()
    assert [r.idx for r in got] == brute.fpf(brute.matrix(items), 6, 3)
    assert [r.prototype_index for r in got] == list(range(1, 7))


def test_fpf_per_class_with_hot_class_and_copies(spark):
    texts = brute.tag_texts(24, 6)
    items = [texts[0] if i % 3 == 0 else texts[i] for i in range(24)]
    label = lambda i: "legit" if i in (1, 5, 7, 11) else "phish"
    got = P.fpf_select(samples(spark, items, label), 5, by="label", first="lowest").collect()
    phish = [i for i in range(24) if label(i) == "phish"]
    m = brute.matrix([items[i] for i in phish])
    assert [r.idx for r in sorted(got, key=lambda r: r.prototype_index) if r.label == "phish"] == [
        phish[i] for i in brute.fpf(m, 5, 0)]
    assert [(r.idx, r.prototype_index) for r in sorted(got, key=lambda r: r.idx) if r.label == "legit"] == [
        (1, 1), (5, 2), (7, 3), (11, 4)]


def test_fpf_edges(spark):
    s = samples(spark, brute.tag_texts(3, 7))
    assert [r.idx for r in P.fpf_select(s, 5).orderBy("idx").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        P.fpf_select(s, 0)
    with pytest.raises(ValueError):
        P.fpf_select(s, 1, first=99)
    picks = [r.idx for r in P.fpf_select(samples(spark, brute.tag_texts(20, 8)), 5, seed=1).collect()]
    assert len(set(picks)) == 5
    assert picks == [r.idx for r in P.fpf_select(samples(spark, brute.tag_texts(20, 8)), 5, seed=1).collect()]


def test_string_keys(spark):
    items = brute.tag_texts(12, 9)
    s = samples(spark, items).withColumn("path", F.format_string("f%03d", "idx"))
    got = P.fpf_select(s, 4, key="path", first="f002").orderBy("prototype_index").collect()
    assert [r.idx for r in got] == brute.fpf(brute.matrix(items), 4, 2)


def test_covering_radius_shrinks(spark):
    got = P.fpf_select(samples(spark, brute.tag_texts(20, 10)), 6, first="lowest").orderBy("prototype_index").collect()
    radii = [r.cover_distance for r in got[1:]]
    assert radii == sorted(radii, reverse=True)


def test_build_filters_minimal_and_names(spark):
    items = [b"p " * 10] * 3 + brute.tag_texts(12, 11, words=("section", "article", "header"))
    s = samples(spark, items, lambda i: "phish" if i % 2 else "legit")
    kept = P.filter_minimal(s, 100)
    built = P.build_prototypes(s, 3, minimal_threshold=100, first="lowest")
    names = sorted(r.name for r in built.collect())
    assert names == [f"{c}_prototype_{i:02d}" for c in ("legit", "phish") for i in (1, 2, 3)]
    assert all(r["size"] == len(r.dom) >= 100 for r in built.collect())
    summary = {r.label: r for r in P.prototype_build_summary(kept, built).collect()}
    assert summary["phish"].k == 3 and summary["phish"].prototypes[0] == "phish_prototype_01"
    assert P.build_prototypes(s, 2, filter_minimal_doms=False).count() == 4


@pytest.mark.parametrize("gain", [0.001, -1.0, 10.0])
def test_clustering_equals_matrix(spark, gain):
    items = brute.tag_texts(18, 12)
    m = brute.matrix(items)
    centres, assigned = brute.clusters(m, 4, gain)
    rows, found, report = P.cluster_samples(samples(spark, items), min_variance_gain=gain)
    assert [r.idx for r in found.orderBy("cluster").collect()] == centres
    got = rows.orderBy("idx").collect()
    assert [r.cluster - 1 for r in got] == assigned
    assert [r.center_distance for r in got] == pytest.approx([m[i][centres[a]] for i, a in enumerate(assigned)])
    for r in report.collect():
        members = [i for i, a in enumerate(assigned) if a == r.cluster - 1]
        inner = [m[i][j] for i in members for j in members if i < j]
        assert r["size"] == len(members) and r.center == centres[r.cluster - 1]
        if inner:
            assert (r.min_distance, r.max_distance) == (min(inner), max(inner))
            assert r.avg_distance == pytest.approx(sum(inner) / len(inner))


def test_clustering_needs_two(spark):
    with pytest.raises(ValueError):
        P.fpf_cluster(samples(spark, brute.tag_texts(1)))


def test_cover_variance(spark):
    items = brute.tag_texts(10, 13)
    m = brute.matrix(items)
    got = {r.centres: r.variance for r in P.cover_variance(samples(spark, items), [2, 7]).collect()}
    assert got[1] == pytest.approx(brute.variance([m[i][2] for i in range(10)]))
    assert got[2] == pytest.approx(brute.variance([min(m[i][2], m[i][7]) for i in range(10)]))


def test_first_centre_of_each_class(spark):
    rows = [(k, "a" if k < 6 else "b", [float(k), 0.0]) for k in range(12)]
    df = spark.createDataFrame(rows, "idx long, label string, vec array<double>")
    options = {"by": "label", "payload": "vec", "distance": "l2"}
    out = P.fpf_select(df, 2, first={"a": 2, "b": 11}, **options).collect()
    assert {(r.label, r.prototype_index): r.idx for r in out} == {("a", 1): 2, ("a", 2): 5, ("b", 1): 11, ("b", 2): 6}
    with pytest.raises(ValueError, match="'b'"):
        P.fpf_select(df, 2, first=2, **options)
