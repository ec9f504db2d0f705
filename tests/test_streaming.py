import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagesim.plans.detect import detect
from pagesim.sources import writers as K
from pagesim.streaming import jobs

from . import brute


def stream_of(spark, frames, path):
    """One file per frame; each becomes its own micro-batch."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{path}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_table(spark, stream, tmp_path, name):
    out = str(tmp_path / name)
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def checks(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), u) for i, m, u in rows],
                                 "event_id long, ts timestamp, url string")


def test_detect_stream_equals_batch_and_sees_new_feed(spark, tmp_path):
    protos = spark.createDataFrame([("phish" if i < 2 else "legit", i, d) for i, d in enumerate(brute.tag_texts(4, 40))],
                                   "label string, prototype_index int, dom binary")
    pages = spark.createDataFrame([(f"https://{c}.org/", f"<html><{t}>x</{t}></html>") for c, t in zip("abc", ("p", "div", "b"))],
                                  "url string, html string")
    def feed(urls):
        return spark.createDataFrame([(i, u, "t", "T") for i, u in enumerate(urls)], "phish_id long, url string, submission_time string, target string")
    root = str(tmp_path / "feed")
    K.publish_signatures(feed(["https://a.org/"]), root, 1)
    first, second = checks(spark, [(1, 0, "https://a.org/"), (2, 0, "https://b.org/")]), checks(spark, [(3, 1, "https://b.org/"), (4, 1, "https://c.org/")])
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def answer(batch, signatures):
        return detect(batch.drop("ts"), pages, signatures, protos, detection_id=F.col("event_id")).drop("detected_at")

    def run(stream):
        jobs.detect_stream(stream, jobs.with_current_feed(root, answer), out, cp).awaitTermination()

    run(stream_of(spark, [first], source))
    K.publish_signatures(feed(["https://a.org/", "https://b.org/"]), root, 2)
    run(stream_of(spark, [second], source))
    run(stream_of(spark, [second.limit(0)], source))  # a restart with nothing new repeats nothing
    got = spark.read.parquet(out).drop("batch_id")
    want = answer(first, feed(["https://a.org/"])).unionByName(answer(second, feed(["https://a.org/", "https://b.org/"])))
    assert sorted(got.select(*want.columns).collect(), key=lambda r: r.event_id) == sorted(want.collect(), key=lambda r: r.event_id)
    assert {r.event_id: r.source for r in got.collect()} == {1: "signature-local", 2: "ncd", 3: "signature-local", 4: "ncd"}


def test_dedupe_within_ttl(spark, tmp_path):
    """A kept check answers for an hour, however the checks fall into micro-batches."""
    frames = [checks(spark, [(1, 0, "a"), (2, 30, "a"), (3, 10, "b"), (9, 60, "a")]), checks(spark, [(4, 65, "a"), (5, 300, "z"), (8, 119, "a")]),
              checks(spark, [(6, 400, "a"), (7, 401, "a"), (10, 460, "a")])]
    source = str(tmp_path / "in")
    for i, frame in enumerate(frames):
        stream = stream_of(spark, [frame], source)
        kept = run_to_table(spark, jobs.dedupe_checks(stream).select("event_id", "url"), tmp_path, "out")
    assert sorted(r.event_id for r in kept.collect()) == [1, 3, 5, 6, 9, 10]


def test_late_checks_that_nothing_answers_are_kept(spark, tmp_path):
    """A check older than one that was kept already, within the delay; columns that Spark's rows cannot name."""
    frames = [checks(spark, [(1, 0, "a"), (2, 200, "a"), (7, 200, "b")]), checks(spark, [(3, 100, "a"), (4, 30, "a"), (5, 150, "a"), (6, 259, "a")]),
              checks(spark, [(8, 140, "b"), (9, 159, "a")])]
    source = str(tmp_path / "in")
    for frame in frames:
        stream = stream_of(spark, [frame.withColumn("_x", F.lit(1))], source)
        kept = run_to_table(spark, jobs.dedupe_checks(stream, late="3 hours").select("event_id", "url", "_x"), tmp_path, "out")
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 3, 7, 8]


def test_every_feedback_gets_one_answer(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    def at(minutes):
        return t0 + dt.timedelta(minutes=minutes)
    known = spark.createDataFrame([("0", "u0", "legit", at(0)), ("1", "u1", "phish", at(1)), ("beat", None, None, at(6000))],
                                  "detection_id string, url string, verdict string, detected_at timestamp")
    entries = spark.createDataFrame([("0", "yes", at(5)), ("1", "maybe", at(5)), ("1", None, at(6)), ("99", "NO", at(7)), ("0", "no", at(180)),
                                     (None, "yes", at(8)), ("alive", "yes", at(6000))], "id string, correct string, ts timestamp")
    later = spark.createDataFrame([("alive", "yes", at(9000))], entries.schema)
    later_known = spark.createDataFrame([("beat", None, None, at(9000))], known.schema)
    joined = jobs.feedback_stream(stream_of(spark, [entries, later], str(tmp_path / "f")), stream_of(spark, [known, later_known], str(tmp_path / "d")), rejected=True)
    out = run_to_table(spark, joined, tmp_path, "out")
    assert sorted((r.id, r.correct or "", r.status, r.url or "") for r in out.where("id != 'alive'").collect()) == [
        ("0", "no", 404, ""), ("0", "yes", 200, "u0"), ("1", "", 400, ""), ("1", "maybe", 400, ""), ("99", "NO", 404, "")]


def test_feedback_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    known = spark.createDataFrame([(str(i), f"u{i}", "legit", t0 + dt.timedelta(minutes=i)) for i in range(4)],
                                  "detection_id string, url string, verdict string, detected_at timestamp")
    entries = spark.createDataFrame([
        ("0", "yes", t0 + dt.timedelta(minutes=5)), ("1", "maybe", t0 + dt.timedelta(minutes=5)),
        ("2", "NO", t0 + dt.timedelta(hours=3)), ("3", "no", t0 - dt.timedelta(minutes=1)), ("99", "yes", t0)],
        "id string, correct string, ts timestamp")
    joined = jobs.feedback_stream(stream_of(spark, [entries], str(tmp_path / "f")), stream_of(spark, [known], str(tmp_path / "d")))
    out = run_to_table(spark, joined, tmp_path, "out")
    assert [(r.id, r.user_feedback, r.url) for r in out.collect()] == [("0", "yes", "u0")]


def test_metrics_stream(spark, tmp_path):
    frames = [spark.createDataFrame([("ncd",), ("error",)], "source string"), spark.createDataFrame([("ncd",)], "source string")]
    counts = jobs.metrics_stream(stream_of(spark, frames, str(tmp_path / "in")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("metric_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.source: r.detections for r in spark.table("metric_counts").collect()} == {"ncd": 2, "error": 1}
