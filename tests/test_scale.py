"""What keeps large inputs cheap: few and wide blocks, distinct payloads, one timer for each url, short tasks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesim.functions.kernel import kernel
from pagesim.operators import distances as D
from pagesim.operators import prototypes as P
from pagesim.sources import readers
from pagesim.streaming.jobs import _KeepOnePerLifetime

DOMS = [b"<html><body>", b"<html><div><p>", b"<form><input>", b"<a><b><i><u>"]


def samples(spark, n):
    return spark.createDataFrame([(i, bytearray(DOMS[i * i % 4]), i % 2) for i in range(n)], "idx long, dom binary, half int")


def test_blocks_of_cheap_distances_are_wide():
    assert D._blocks(100_000, 0, 192, None, True) < 20
    assert D._blocks(600_000, 0, 192, None, True) < 2 * D._blocks(100_000, 0, 192, None, True)


@pytest.mark.parametrize("positions", [3, 1 << 20])
def test_ordered_pairs_by_payload(spark, monkeypatch, positions):
    """Copies are measured once, and every pair counts in the order of its keys."""
    monkeypatch.setattr(D, "POSITIONS", positions)
    n, k = 24, kernel("ncd")
    ready = [k.prepare(DOMS[i * i % 4]) for i in range(n)]
    full = np.array([[0.0 if i == j else k.pair(ready[min(i, j)], ready[max(i, j)]) for j in range(n)] for i in range(n)])
    means = {r.idx: r.mean_distance for r in D.mean_distance(samples(spark, n)).collect()}
    assert [means[i] for i in range(n)] == pytest.approx(full.mean(axis=1).tolist(), abs=1e-12)
    for r in D.group_distance_stats(samples(spark, n), "half").collect():
        own = [full[i, j] for i in range(n) for j in range(i + 1, n) if i % 2 == j % 2 == r.half]
        assert (r.pairs, r.min_distance, r.max_distance) == (len(own), min(own), max(own))
        assert r.avg_distance == pytest.approx(sum(own) / len(own))


def test_grid_places_distinct_payloads(spark, monkeypatch):
    placed, place = [], D._place
    monkeypatch.setattr(D, "_place", lambda cands, others, *rest: placed.append((cands.count(), others.count())) or place(cands, others, *rest))
    s = samples(spark, 24).withColumn("one", F.lit(1))
    got = {r.idx2: r for r in D.grid_scores(s.withColumnRenamed("idx", "idx2"), s, "idx2", set_col="one", exclude="idx").collect()}
    assert placed == [(2, 2)]  # squares modulo 4 are 0 and 1
    k = kernel("ncd")
    ready = [k.prepare(DOMS[i * i % 4]) for i in range(24)]
    for i in range(24):
        d = [k.pair(ready[i], ready[j]) for j in range(24)]
        near = min((d[j], j) for j in range(24) if j != i)
        assert (got[i].min_distance, got[i].idx, got[i].n) == (*near, 24)
        assert got[i].total == pytest.approx(sum(d))


def test_rows_are_measured_together(monkeypatch):
    """From one centre: one matrix for points, one compression for equal payloads."""
    points, l2 = [np.arange(3.0) + i for i in range(5)], kernel("l2")
    monkeypatch.setattr(l2, "pair", lambda *_: pytest.fail("one by one"))
    assert P._from_centre(l2, list(range(5)), points, 9, points[0]).tolist() == pytest.approx([i * math.sqrt(3) for i in range(5)])
    ncd, calls = kernel("ncd"), []
    pair = ncd.pair
    monkeypatch.setattr(ncd, "pair", lambda a, b: calls.append(1) or pair(a, b))
    P._from_centre(ncd, [0, 1, 8, 9], [DOMS[0]] * 4, 5, ncd.prepare(DOMS[1]))
    assert len(calls) == 2  # before the centre and behind it
    assert np.isnan(P._from_centre(l2, [0, 1], points[:2], 9, None)).all()


class _Handle:
    def __init__(self):
        self.timers, self.rows = [], []

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.rows)

    def exists(self):
        return bool(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)


class _Time:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_one_timer_for_each_url():
    import pandas as pd

    handle, keep = _Handle(), _KeepOnePerLifetime(["ts"], 1_000_000)
    keep.init(handle)
    rows = pd.DataFrame({"ts": range(10), "_us": [i * 2_000_000 for i in range(10)]})
    assert sum(len(f) for f in keep.handleInputRows(("u",), iter([rows]), _Time(0))) == 10
    assert len(handle.timers) == 1
    list(keep.handleExpiredTimer(("u",), _Time(9_500), _Time(handle.timers[0])))
    assert len(handle.rows) == 5 and len(handle.timers) == 2
    list(keep.handleExpiredTimer(("u",), _Time(60_000), _Time(handle.timers[1])))
    assert not handle.rows and len(handle.timers) == 2


def test_pages_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "PAGES_PER_TASK", 2)
    path = str(tmp_path / "pages")
    spark.range(64).selectExpr("id page_id", "'u' url", "'<p>' html").coalesce(1).write.parquet(path)
    assert readers.read_html_pages(spark, path).rdd.getNumPartitions() == 32
