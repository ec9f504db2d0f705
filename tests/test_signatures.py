import random

import pytest
from pyspark.sql import functions as F

from pagesim.operators import signatures as G
from pagesim.sources import readers, writers

from . import brute

HEADER = "phish_id,url,phish_detail_url,submission_time,verified,verification_time,online,target\n"


@pytest.mark.parametrize("unique_url", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_replace_equals_sequential_upserts(spark, unique_url, seed):
    """Few ids and urls, so chains of evictions on both keys occur; one hot key."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, *range(12)]), f"u{rng.choice([0, 0, *range(12)])}", i) for i in range(150)]
    feed = spark.createDataFrame([(p, u, str(i), i) for p, u, i in rows],
                                 "phish_id long, url string, submission_time string, input_seq long")
    out = G.replace_signatures(feed, "unique_url" if unique_url else "pk_only", F.lit("now"))
    got = sorted((r.phish_id, r.url, int(r.submission_time)) for r in out.collect())
    assert got == brute.insert_or_replace(rows, unique_url)


def test_replace_is_idempotent(spark):
    feed = spark.createDataFrame([(1, "a", "x", 0), (1, "b", "y", 1), (2, "b", "z", 2)],
                                 "phish_id long, url string, target string, input_seq long")
    once = G.replace_signatures(feed, updated_at=F.lit("t"))
    again = G.replace_signatures(once.withColumn("input_seq", F.lit(1)), updated_at=F.lit("t"))
    assert once.select(*again.columns).collect() == again.collect()
    with pytest.raises(ValueError):
        G.replace_signatures(feed, "other")


def test_feed_csv(spark, tmp_path):
    (tmp_path / "feed.csv").write_text(
        HEADER + '7,"http://a/?x=1,2",d,2024,yes,v,yes,"Say ""hi"""\n8,http://b,d,,no,v,yes,T\n'
        "9,http://c,d,2024,yes,v,no,T\n10,http://d,d,,yes,v,yes,\n")
    rows = readers.read_feed_csv(spark, str(tmp_path / "feed.csv")).orderBy("phish_id").collect()
    assert [(r.phish_id, r.url, r.submission_time, r.target) for r in rows] == [
        (7, "http://a/?x=1,2", "2024", 'Say "hi"'), (10, "http://d", "", "")]


def test_feed_csv_upsert_follows_file_order(spark, tmp_path):
    lines = "".join(f"{i % 5},http://u{i % 7},d,{i},yes,v,yes,T\n" for i in range(60))
    (tmp_path / "feed.csv").write_text(HEADER + lines)
    table = G.replace_signatures(readers.read_feed_csv(spark, str(tmp_path / "feed.csv")))
    got = sorted((r.phish_id, r.url, int(r.submission_time)) for r in table.collect())
    assert got == brute.insert_or_replace([(i % 5, f"http://u{i % 7}", i) for i in range(60)])


def test_feed_csv_bad_id_aborts(spark, tmp_path):
    (tmp_path / "feed.csv").write_text(HEADER + "x,http://a,d,t,yes,v,yes,T\n")
    with pytest.raises(Exception):
        readers.read_feed_csv(spark, str(tmp_path / "feed.csv")).collect()


def test_feed_json(spark, tmp_path):
    (tmp_path / "feed.json").write_text(
        '[{"phish_id": 1, "url": "http://a", "verified": "yes", "phish_detail_url": "d", "target": "T"},'
        ' {"phish_id": 2, "url": "http://a", "verified": "no"}]')
    feed = readers.read_feed_json(spark, str(tmp_path / "feed.json"))
    assert [(r.phish_id, r.verified, r.detail_url) for r in feed.orderBy("phish_id").collect()] == [(1, 1, "d"), (2, 0, None)]
    assert G.replace_signatures(feed, "pk_only").count() == 2


def test_lookup(spark):
    feed = spark.createDataFrame([(5, "http://x/", "t", "Bank")], "phish_id long, url string, submission_time string, target string")
    urls = spark.createDataFrame([("http://x/",), ("http://X/",), ("http://x/",)], "url string")
    rows = G.signature_lookup(urls, feed).orderBy("url").collect()
    assert [r.in_database for r in rows] == [False, True, True]
    assert rows[1].detail_page.endswith("=5") and rows[1].submitted_at == "t" and rows[0].phish_id is None
    skipped = G.signature_lookup(urls, feed, skip_signature=True).collect()
    assert {(r.in_database, r.lookup_source) for r in skipped} == {(False, "skipped")}
    assert G.signature_hits(urls, feed).count() == 2 and G.signature_misses(urls, feed).count() == 1


def test_stats_and_versions(spark, tmp_path):
    root = str(tmp_path / "signatures")
    with pytest.raises(FileNotFoundError):
        writers.current_signatures(spark, root)
    for version, n in ((1, 3), (2, 5)):
        table = spark.range(n).select(F.col("id").alias("phish_id"), F.col("id").cast("string").alias("url"), F.lit("t").alias("updated_at"))
        writers.publish_signatures(table, root, version)
    table.write.parquet(f"{root}/version=3")  # written but never announced
    now = writers.current_signatures(spark, root)
    assert G.signature_stats(now).first().entry_count == 5
    assert G.signature_stats(now.limit(0)).first().exists is False
    assert G.stored_size_mb(spark, root) >= 0


def test_bucketed_feed_is_neither_shuffled_nor_aggregated(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("phish_id"), F.concat(F.lit("u"), F.col("id")).alias("url"),
                                    F.lit("t").alias("submission_time"), F.lit("x").alias("target"), F.col("id").alias("input_seq"))
    feed = G.replace_signatures(rows)
    stored = writers.write_signatures(feed, "test_bucketed_signatures", str(tmp_path / "feed"), 4)
    urls = spark.range(5000).select(F.concat(F.lit("u"), F.col("id")).alias("url"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        found = G.signature_lookup(urls, stored, unique=True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
        assert found.where("in_database").count() == 2000 and found.count() == 5000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        spark.sql("DROP TABLE test_bucketed_signatures")


def test_feed_changes(spark):
    schema = "phish_id long, url string, submission_time string, target string"
    old = spark.createDataFrame([(1, "same", "t", "a"), (2, "gone", "t", "a"), (3, "moved", "t", "a"), (9, None, "t", "a"), (5, "same", "t", "b")], schema)
    new = spark.createDataFrame([(1, "same", "t", "a"), (4, "moved", "t", "a"), (6, "new", None, None)], schema)
    assert {(r.url, r.change) for r in G.feed_changes(old, new).collect()} == {("gone", "gone"), ("moved", "changed"), ("new", "added")}
    assert G.feed_changes(old, old).count() == 0
