"""Points whose distances all lie close together, and blocks of bounded size on both sides of a search."""

import numpy as np
import pytest

from pagesim.functions.kernel import L2Closest, kernel
from pagesim.operators import nearest as N
from pagesim.operators.prototypes import fpf_cluster

POINTS = "idx long, dom array<double>"


def directions(n, width=24, seed=5):
    """Unit vectors, each with its opposite: their mean squares are all equal."""
    x = np.random.default_rng(seed).normal(size=(n // 2, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return np.concatenate([x, -x])


def apart(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def table(spark, points, keys=None):
    keys = range(len(points)) if keys is None else keys
    return spark.createDataFrame([(int(k), p.tolist()) for k, p in zip(keys, points)], POINTS).repartition(4)


def lowest_farthest(points, keys):
    means = apart(points, points).mean(1)
    return min(k for k, m in zip(keys, means) if m > means.max() - 1e-11 * means.max())


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (2000.0, 0.0), (0.001, 0.0), (3.0, 400.0)])
def test_equal_mean_squares_still_rule_rows_out(spark, scale, shift):
    points, report = directions(600) * scale + shift, []
    points[7] *= 1 + 1e-4  # one that is farther than its equals
    keys = list(range(600))
    assert N.farthest_on_average(table(spark, points), distance="l2", report=report) == lowest_farthest(points, keys)
    assert report[0]["measured"] < 0.5 * 600


def test_centres_of_equal_mean_squares(spark, monkeypatch):
    """The clusters' first centre takes a few passes over the rows, not one for each 512 of them."""
    points, passes, means = directions(900), [], N._mean_distances
    monkeypatch.setattr(N, "_mean_distances", lambda rows, few, n: passes.append(len(few)) or means(rows, few, n))
    out = fpf_cluster(table(spark, points), min_variance_gain=-1.0, distance="l2").orderBy("cluster").collect()
    d = apart(points, points)
    chosen = [lowest_farthest(points, list(range(900)))]
    while len(chosen) < 4:
        near = np.round(d[chosen].min(0), 12)
        chosen.append(int(near.argmax()))
    assert [r.idx for r in out] == chosen
    assert len(passes) <= 3 and sum(passes) < 0.5 * 900


@pytest.mark.parametrize("copies", [1, 3])
def test_all_pairs_where_bounds_rule_nothing_out(spark, monkeypatch, copies):
    """Wide points have the bound by mean squares only; equal points count each, keys may repeat."""
    monkeypatch.setattr(N, "MOMENTS_WIDTH", 0)
    monkeypatch.setattr(N, "FIRST_MEASURED", 4)
    monkeypatch.setattr(N, "MOST_MEASURED", 16)
    points = np.concatenate([directions(200)] * copies)
    keys = [i // 2 + 10 for i in range(len(points))]
    report, passes, means = [], [], N._mean_distances
    monkeypatch.setattr(N, "_mean_distances", lambda rows, few, n: passes.append(len(few)) or means(rows, few, n))
    assert N.farthest_on_average(table(spark, points, keys), distance="l2", report=report) == lowest_farthest(points, keys)
    assert report[0] == {"rows": len(points), "measured": len(points)} and passes == [4, 16]


def test_equal_points_are_measured_once(spark):
    report = []
    points = np.array([[1.0, 2.0]] * 300 + [[1.0, 2.5]] * 300)
    assert N.farthest_on_average(table(spark, points[::-1], range(600, 0, -1)), distance="l2", report=report) == 1
    assert report[0]["measured"] <= N.FIRST_MEASURED + 2


@pytest.mark.parametrize("exclude_self", [False, True])
def test_queries_of_a_cell_come_in_parts(spark, monkeypatch, exclude_self):
    monkeypatch.setattr(N, "CELL_BLOCK", 8)
    cells, partitions = [], N._cell_partitions
    monkeypatch.setattr(N, "_cell_partitions", lambda session, n: cells.append(n) or partitions(session, n))
    points = np.concatenate([directions(240, 12), directions(240, 12)[:30], directions(240, 12)[:30] + 1e-9, [[5.0] * 12] * 3])
    keys = np.random.default_rng(1).permutation(len(points))
    df = table(spark, points, keys)
    few = df.where("idx < 30") if not exclude_self else df
    out = N.nearest(df, few.withColumnRenamed("idx", "nearest"), key="idx", order_col="nearest", distance="l2", exclude_self=exclude_self).collect()
    assert max(cells) >= len(points) / 16  # no cell takes more than 16 queries with 8 samples
    got, l2 = {r.idx: (r.min_distance, r.nearest) for r in out}, kernel("l2")
    assert len(out) == len(points)
    for k, p in zip(keys, points):
        want = min((l2.pair(p, q), int(o)) for o, q in zip(keys, points) if (exclude_self or o < 30) and not (exclude_self and o == k))
        assert abs(got[k][0] - want[0]) < 1e-12 and (got[k][1] == want[1] or abs(l2.pair(p, points[keys == got[k][1]][0]) - want[0]) < 1e-15)


@pytest.mark.parametrize("kind", ["plain", "far", "tight", "wild", "equal"])
def test_closest_points_by_single_precision(kind):
    """Whatever the values, the closest point is among the found ones, with its exact distance."""
    draw = np.random.default_rng(3)
    points, asks = draw.normal(size=(400, 16)), draw.normal(size=(50, 16))
    if kind == "far":
        points, asks = points + 1e6, asks + 1e6
    elif kind == "tight":
        points, asks = points * 1e-9 + 1.0, asks * 1e-9 + 1.0
    elif kind == "wild":
        points, asks = points * 10.0 ** draw.integers(-12, 12, size=(400, 1)), asks * 10.0 ** draw.integers(-30, 30, size=(50, 1))
    elif kind == "equal":
        points, asks[:10] = np.ones((400, 16)), 1.0
    closest, none = L2Closest(points), (np.zeros(0, int), np.zeros(0, int))
    d = apart(asks, points)
    for reach in (np.full(50, np.inf), d.min(1), d.min(1) / 2 - 1e-3):
        i, j, found = closest.near(asks, reach, 0, 400, none)
        assert np.allclose(found, d[i, j], rtol=1e-12)
        for row in range(50):
            if d[row].min() <= reach[row]:
                assert d[row].argmin() in j[i == row]
    if kind == "plain":
        assert len(closest.near(asks, np.full(50, np.inf), 0, 400, none)[0]) < 60
        i, j, _ = closest.near(asks, np.full(50, np.inf), 100, 300, (np.arange(50), d[:, 100:300].argmin(1)))
        d[:, :100], d[:, 300:] = np.inf, np.inf
        d[np.arange(50), d.argmin(1)] = np.inf
        assert all(d[row].argmin() in j[i == row] for row in range(50))


def test_near_pairs_of_very_different_sizes():
    """A strip's near pairs are measured by their gaps, whichever rows they lie in."""
    l2, draw = kernel("l2"), np.random.default_rng(8)
    points = draw.normal(size=(60, 5)) * 10.0 ** np.repeat([0, 3, 6], 20)[:, None]
    points = np.concatenate([points, points + 1e-7, points[:5]])
    found = l2.matrix(list(points), list(points))
    want = apart(points, points)
    assert np.allclose(found, want, rtol=1e-9, atol=0.0) and ((found == 0) == (want == 0)).all()
