import random

import pytest
from pyspark.sql import functions as F

from pagesim.operators import distances as D
from pagesim.operators import scores as S
from pagesim.operators import tuning as T

from . import brute


@pytest.fixture(scope="module")
def sets(spark):
    cands, protos = brute.tag_texts(25, 1), brute.tag_texts(9, 2)
    c = spark.createDataFrame(list(enumerate(cands)), "page_id long, dom binary")
    p = spark.createDataFrame([(i, "phish" if i % 3 else "legit", f"u{i}", d) for i, d in enumerate(protos)],
                              "idx long, label string, url string, dom binary")
    return cands, protos, c, p.withColumn("prototype_index", F.col("idx").cast("int"))


def expected(cands, protos, label):
    out = []
    for x in cands:
        ds = [brute.ncd(x, p) for i, p in enumerate(protos) if ("phish" if i % 3 else "legit") == label]
        out.append((min(ds), sum(ds) / len(ds)))
    return out


@pytest.mark.parametrize("way", ["broadcast", "grid"])
def test_class_scores(spark, sets, way, monkeypatch):
    cands, protos, c, p = sets
    if way == "grid":
        monkeypatch.setattr(D, "MAX_BROADCAST_ROWS", 0)
        monkeypatch.setattr(D, "BLOCK_ROWS", 4)
        monkeypatch.setattr(S.PrototypeSet, "load", classmethod(lambda cls, *a, **k: None))
    rows = S.class_scores(c, p, key="page_id").orderBy("page_id").collect()
    for label in ("phish", "legit"):
        for r, (low, mean) in zip(rows, expected(cands, protos, label)):
            assert r[f"{label}_min"] == pytest.approx(low) and r[f"{label}_avg"] == pytest.approx(mean)


def test_bound_is_checked(spark, sets):
    _, _, _, p = sets
    assert D.PrototypeSet.load(p, max_rows=8) is None
    assert D.PrototypeSet.load(p, max_bytes=10) is None
    assert len(D.PrototypeSet.load(p).rows) == 9


def test_absent_class_and_empty_set(spark, sets):
    _, _, c, p = sets
    only = S.class_scores(c, p.filter("label = 'phish'")).first()
    assert (only.legit_min, only.legit_avg) == (1.0, 1.0) and only.phish_min < 1.5
    none = S.class_scores(c, p.limit(0)).first()
    assert (none.phish_min, none.legit_avg) == (1.0, 1.0)


def test_grid_needs_no_pair_rows_and_spreads_copies(spark):
    """A third of the candidates are copies of one page: hashing on the unique key spreads them."""
    texts = brute.tag_texts(30, 3)
    doms = [texts[0] if i % 3 == 0 else texts[i] for i in range(30)]
    c = spark.createDataFrame(list(enumerate(doms)), "page_id long, dom binary")
    s = spark.createDataFrame([(i, "legit", d) for i, d in enumerate(doms)], "idx long, label string, dom binary")
    got = D.grid_scores(c, s, "page_id", block_rows=4).orderBy("page_id").collect()
    for r, x in zip(got, doms):
        ds = [brute.ncd(x, d) for d in doms]
        assert r.n == 30 and r.min_distance == min(ds) and r.idx == ds.index(min(ds))
        assert r.total == pytest.approx(sum(ds))


def test_nearest_sample(spark, sets):
    cands, protos, c, p = sets
    extra = spark.createDataFrame([(100, b""), (101, None)], "page_id long, dom binary")
    rows = {r.page_id: r for r in S.nearest_sample(c.unionByName(extra), p, block_rows=3).collect()}
    for i, x in enumerate(cands):
        ds = [brute.ncd(x, q) for q in protos]
        j = ds.index(min(ds))
        label = "phish" if ds[j] > 0.48 else ("phish" if j % 3 else "legit")
        assert (rows[i].classification, rows[i].closest_sample) == (label, f"u{j}")
        assert rows[i].ncd == pytest.approx(ds[j], abs=1e-4)
    assert rows[100].classification == rows[101].classification == "error"


def test_nearest_of_nothing(spark, sets):
    _, _, c, p = sets
    row = S.nearest_sample(c, p.limit(0)).first()
    assert (row.ncd, row.classification, row.closest_sample) == (1.0, "phish", None)


@pytest.mark.parametrize("block_rows", [3, 100])
def test_pairs_and_means(spark, block_rows):
    items = brute.tag_texts(14, 4)
    s = spark.createDataFrame([(i, i % 2, d) for i, d in enumerate(items)], "idx long, half int, dom binary")
    m = brute.matrix(items)
    pairs = {(r.i, r.j): r.distance for r in D.pairwise_distances(s, block_rows=block_rows).collect()}
    assert pairs == {(i, j): m[i][j] for i in range(14) for j in range(i + 1, 14)}
    means = {r.idx: r.mean_distance for r in D.mean_distance(s, block_rows=block_rows).collect()}
    assert means == pytest.approx({i: sum(m[i]) / 14 for i in range(14)})
    stats = {r.half: r for r in D.group_distance_stats(s, "half", block_rows=block_rows).collect()}
    for half in (0, 1):
        ds = [m[i][j] for i in range(half, 14, 2) for j in range(i + 2, 14, 2)]
        assert stats[half].pairs == len(ds) and stats[half].min_distance == min(ds)
        assert stats[half].max_distance == max(ds)
        assert stats[half].avg_distance == pytest.approx(sum(ds) / len(ds))


def test_tune_threshold(spark, sets):
    _, protos, _, p = sets
    legit = [d for i, d in enumerate(protos) if not i % 3]
    phish = [d for i, d in enumerate(protos) if i % 3]
    ll = [d for d in (brute.ncd(x, y) for x in legit for y in legit) if d != 0]
    lp = [brute.ncd(x, y) for x in legit for y in phish]
    row = T.tune_threshold(p.filter("label = 'legit'"), p.filter("label = 'phish'")).first()
    assert (row.ll_comparisons, row.lp_comparisons) == (len(ll), len(lp))
    assert (row.ll_max, row.lp_min) == (max(ll), min(lp))
    assert row.suggested_threshold == pytest.approx((max(ll) + min(lp)) / 2)
    assert row.separated == (max(ll) < min(lp))


def test_cluster_scores_with_an_absent_set(spark, sets):
    cands, protos, c, p = sets
    named = p.withColumn("proto_set", F.when(F.col("label") == "legit", "legit").otherwise("phish_cluster_1"))
    row = S.cluster_scores(c, named).orderBy("page_id").first()
    assert (row.ncd_phish_cluster_3_min, row.ncd_phish_cluster_2_avg) == (1.0, 1.0)
    assert row.ncd_phish_best == min(row.ncd_phish_cluster_1_min, 1.0)
    assert row.ncd_phish_avg == pytest.approx((row.ncd_phish_cluster_1_avg + 2.0) / 3)
