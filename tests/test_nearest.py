import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesim.functions.kernel import kernel
from pagesim.operators.distances import mean_distance
from pagesim.operators.nearest import farthest_on_average, nearest
from pagesim.operators.prototypes import fpf_cluster, fpf_select

DOMS = "page_id long, idx long, label string, url string, dom binary"


def doms(n, seed=3, kinds=14):
    """Tag lists of several families, many alike, some alone, one empty."""
    draw = random.Random(seed)
    families = [[f"t{draw.randint(0, 60)}" for _ in range(draw.randint(1, 25))] for _ in range(kinds)]
    rows = []
    for i in range(n):
        tags = list(draw.choice(families))
        for _ in range(draw.randint(0, 6)):
            tags.append(f"t{draw.randint(0, 80)}")
        rows.append((i, i, "phish" if i % 3 else "legit", f"u{i}", " ".join(tags).encode()))
    rows += [(n, n, "legit", "alone", b"only-here"), (n + 1, n + 1, "legit", "twin", rows[0][4]), (n + 2, n + 2, "phish", "nothing", b"")]
    return rows


def plain(cands, samples, distance, exclude_self=False):
    k = kernel(distance)
    there = [(o, k.prepare(p)) for o, p in samples if p is not None]
    out = {}
    for key, payload in cands:
        if payload is None:
            continue
        mine = k.prepare(payload)
        found = [(k.pair(mine, p), o) for o, p in there if not (exclude_self and o == key)]
        if found:
            out[key] = min(found)
    return out


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("method", ["auto", "grid"])
def test_nearest_tag_sets(spark, exclude_self, method):
    rows = doms(150)
    df = spark.createDataFrame(rows, DOMS).repartition(4)
    report = []
    out = nearest(df, df, distance="tag_jaccard", carry=("label", "url"), exclude_self=exclude_self, report=report, method=method)
    got = {r.page_id: (r.min_distance, r.idx) for r in out.collect()}
    assert got == plain([(r[0], r[4]) for r in rows], [(r[1], r[4]) for r in rows], "tag_jaccard", exclude_self)
    assert {(r.idx, r.label, r.url) for r in out.collect()} <= {(r[1], r[2], r[3]) for r in rows}
    if method == "auto":
        assert sum(r["pairs"] for r in report) < len(rows) ** 2 / 2


@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_points(spark, exclude_self):
    """Clustered points, repeated ones, ties, missing payloads."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(9, 8)) * 20
    rows = [(i, i, (centres[i % 9] + draw.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300, 300, rows[5][2]), (301, 301, rows[5][2]), (302, 302, None)]
    df = spark.createDataFrame(rows, "page_id long, idx long, dom array<double>").repartition(4)
    report = []
    got = {r.page_id: (r.min_distance, r.idx) for r in nearest(df, df, distance="l2", exclude_self=exclude_self, report=report).collect()}
    want = plain([(r[0], r[2]) for r in rows], [(r[1], r[2]) for r in rows], "l2", exclude_self)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    assert sum(r["pairs"] for r in report) < 0.5 * 303 ** 2


def test_nearest_without_samples(spark):
    df = spark.createDataFrame(doms(3), DOMS)
    points = spark.createDataFrame([(1, 1, [1.0, 2.0])], "page_id long, idx long, dom array<double>")
    for distance, rows in (("tag_jaccard", df), ("l2", points)):
        assert nearest(rows, rows.limit(0), distance=distance).count() == 0
        assert nearest(rows.limit(0), rows, distance=distance).count() == 0


def test_farthest_point_by_bounds(spark):
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(size=16).tolist()) for i in range(400)] + [(400, [3.0] * 16), (401, [3.0] * 16)]
    df = spark.createDataFrame(rows, "idx long, dom array<double>").repartition(3)
    report = []
    points = np.array([r[1] for r in rows])
    means = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)).mean(1)
    assert farthest_on_average(df, distance="l2", report=report) == int(np.flatnonzero(means > means.max() - 1e-9)[0])
    assert report[0]["measured"] < 0.2 * report[0]["rows"]


def test_farthest_tag_set_with_repeated_rows(spark):
    rows = doms(80)
    df = spark.createDataFrame(rows, DOMS).repartition(3)
    means = mean_distance(df, distance="tag_jaccard").collect()
    best = max(r.mean_distance for r in means)
    report = []
    got = farthest_on_average(df, distance="tag_jaccard", report=report)
    assert got == min(r.idx for r in means if r.mean_distance > best - 1e-9)
    assert report[0]["measured"] < report[0]["rows"]


def test_clusters_with_the_stop_rule(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (np.eye(4)[i % 3] * 30 + draw.normal(size=4)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "idx long, dom array<double>")
    out = fpf_cluster(df, min_variance_gain=0.5, distance="l2").collect()
    assert 2 <= len(out) <= 4 and all(r.variance_before - r.variance_after >= 0.5 for r in out[1:])


@pytest.mark.parametrize("distance", ["l2", "tag_jaccard", "ncd"])
def test_lazy_selection_picks_the_same_rows(spark, distance):
    """Against measuring every row in every round; with and without classes."""
    draw = np.random.default_rng(9)
    if distance == "l2":
        rows = [(i, "ab"[i % 2], draw.normal(size=3).tolist()) for i in range(200)] + [(200, "c", [0.0] * 3), (201, "c", [1.0] * 3)]
        df = spark.createDataFrame(rows, "idx long, label string, dom array<double>")
    else:
        rows = [(r[0], r[2], r[4]) for r in doms(60)]
        df = spark.createDataFrame(rows, "idx long, label string, dom binary")
    df, k = df.repartition(4), kernel(distance)
    for by in (None, "label"):
        report = []
        got = {}
        for r in fpf_select(df, 5, by=by, distance=distance, first="lowest", report=report).collect():
            got.setdefault(r.label if by else "all", []).append((r.prototype_index, r.idx, r.cover_distance))
        for group, picked in got.items():
            own = sorted((r[0], k.prepare(r[2])) for r in rows if by is None or r[1] == group) if distance == "ncd" else \
                sorted(((r[0], k.prepare(r[2])) for r in rows if by is None or r[1] == group), key=lambda x: x[0])
            if len(own) <= 5:
                assert [p[1] for p in sorted(picked)] == [i for i, _ in own]
                continue
            bound, want, chosen = {i: float("inf") for i, _ in own}, [(1, own[0][0], None)], own[0]
            for n in range(2, 6):
                for i, p in own:
                    if i != chosen[0] and i in bound:
                        bound[i] = min(bound[i], k.pair(p, chosen[1]) if i < chosen[0] else k.pair(chosen[1], p))
                bound.pop(chosen[0])
                best = min(bound, key=lambda i: (-round(bound[i], 12), i))
                want.append((n, best, bound[best]))
                chosen = (best, dict(own)[best])
            got_rows = sorted(picked)
            assert [p[:2] for p in got_rows] == [w[:2] for w in want]
            assert all(abs(p[2] - w[2]) < 1e-9 for p, w in zip(got_rows[1:], want[1:]))
        # a row measured late meets all centres it has missed, never more than measuring it each time would take
        assert all(sum(r["pairs"] for r in report[:n]) <= sum(r["full_pairs"] for r in report[:n]) for n in range(1, 5))
        assert sum(r["pairs"] for r in report) < sum(r["full_pairs"] for r in report)


@pytest.mark.parametrize("distance", ["l2", "tag_jaccard"])
def test_matrix_equals_pairs(distance):
    k = kernel(distance)
    draw = np.random.default_rng(2)
    payloads = draw.normal(size=(20, 6)).tolist() + [[1e3] * 6, [1e3] * 6] if distance == "l2" else [r[4] for r in doms(20)]
    ready = [k.prepare(p) for p in payloads]
    found = k.matrix(ready, ready[3:])
    want = np.array([[k.pair(a, b) for b in ready[3:]] for a in ready])
    assert np.allclose(found, want, rtol=1e-10, atol=1e-12)
    assert (found == 0).sum() == (want == 0).sum()
    assert k.matrix([], ready).shape == (0, len(ready)) and k.matrix(ready, []).shape == (len(ready), 0)
