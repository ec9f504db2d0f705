import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagesim.operators import corpus as C
from pagesim.sources import readers as S
from pagesim.sources import writers as K


def test_url_list(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("http://a\n# note\n\n  http://b  \n #kept\nhttp://a\n")
    assert [r.url for r in S.read_url_list(spark, str(path)).collect()] == ["http://a", "http://b", "#kept", "http://a"]
    assert S.read_url_list(spark, str(tmp_path / "none.txt")).count() == 0


@pytest.fixture
def folder(tmp_path):
    for name, dom, meta in [
        ("1_a", b"html body", {"url": "http://a", "ts": 1, "size": 9, "label": "phish"}), ("2_b", b"p", {"url": "http://b"}),
        ("3_c", b"p p", None), ("4_d", b"", "{broken"),
    ]:
        (tmp_path / f"{name}.dom").write_bytes(dom)
        if meta is not None:
            (tmp_path / f"{name}.meta.json").write_text(meta if isinstance(meta, str) else json.dumps(meta))
    for sub, stem in (("phishing", "x"), ("legit", "y"), ("legit", "z")):
        (tmp_path / sub).mkdir(exist_ok=True)
        (tmp_path / sub / f"{stem}.dom").write_bytes(b"" if stem == "z" else b"div")
    return str(tmp_path)


def test_sample_folders(spark, folder):
    side = {r.stem: r for r in S.read_samples_sidecar(spark, folder).collect()}
    assert {k: (r.label, r.url) for k, r in side.items()} == {"1_a": ("phish", "http://a"), "2_b": ("legit", "http://b")}
    assert side["1_a"].source.ts == 1 and bytes(side["1_a"].dom) == b"html body"
    dirs = S.read_samples_labelled_dirs(spark, folder)
    assert {(r.url, r.label) for r in dirs.collect()} == {("x", "phish"), ("y", "legit"), ("z", "legit")}
    both = C.union_samples(S.read_samples_sidecar(spark, folder), dirs)
    assert both.count() == 5


def test_prototype_folders(spark, folder):
    sets = S.read_prototype_sets(spark, {"legit": f"{folder}/legit", "phish_cluster_1": f"{folder}/phishing", "phish_cluster_3": f"{folder}/none"})
    assert {(r.proto_set, r.stem) for r in sets.collect()} == {("legit", "y"), ("phish_cluster_1", "x")}
    files = S.read_prototypes(spark, folder, "files")
    assert [(r.label, r.stem) for r in files.collect()] == [("phish", "x")]


def test_sinks(spark, tmp_path):
    doms = spark.createDataFrame([("http://a", b"p a"), ("http://b", b"p")], "url string, dom binary")
    ts = F.timestamp_seconds(F.lit(1700000000))
    samples = C.as_samples(doms, F.lit("phish"), ts)
    K.write_samples(samples, str(tmp_path / "s"))
    K.write_samples(samples, str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s")).filter("url = 'http://a'").collect()
    digest = hashlib.sha1(b"http://a1700000000").hexdigest()[:12]
    assert len(rows) == 2 and rows[0].sample_id == f"1700000000_{digest}" and rows[0]["size"] == 3
    counts = K.write_clustered(samples.withColumn("cluster", F.lit(1)), str(tmp_path / "c"))
    assert [tuple(r) for r in counts.collect()] == [(1, 2)]
    K.write_prototypes(samples, str(tmp_path / "p"))
    assert S.read_prototypes(spark, str(tmp_path / "p")).count() == 2
    K.append_feedback(samples, str(tmp_path / "f"))
    K.append_feedback(samples, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4


def test_feedback_log(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps([
        {"id": "1", "url": "u", "verdict": "legit", "user_feedback": "yes", "timestamp": "2025-01-01T10:00:00", "detection_timestamp": "2025-01-01T09:00:00"}]))
    row = S.read_feedback(spark, str(tmp_path / "log.json")).first()
    assert row.user_feedback == "yes" and row.timestamp.hour == 10


def test_manifest_keeps_samples_without_metadata(spark, tmp_path):
    s = spark.createDataFrame([("b",), ("a",), ("c",)], "stem string")
    meta = spark.createDataFrame([("a", "phish"), ("b", None)], "stem string, label string")
    manifest = C.build_manifest(s, meta)
    assert [(r.dom, r.meta, r.label) for r in manifest.collect()] == [
        ("a.dom", "a.meta.json", "phish"), ("b.dom", "b.meta.json", "unknown"), ("c.dom", "c.meta.json", "unknown")]
    K.write_manifest(manifest, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 3


def test_build_samples(spark):
    pages = spark.createDataFrame([("u1", "<p>x</p>"), ("u2", ""), ("u3", "<b>")], "url string, html string")
    urls = spark.createDataFrame([("u1",), ("u1",), ("u2",), ("u9",)], "url string")
    ts = F.timestamp_seconds(F.lit(1))
    assert sorted((r.url, bytes(r.dom)) for r in C.build_samples(urls, pages, "legit", ts).collect()) == [("u1", b"p"), ("u1", b"p")]
    summary = C.ingest_summary(C.build_samples(urls, pages, "legit", ts, keep_failed=True)).first()
    assert tuple(summary) == ("legit", 4, 2, 2)


def test_overview(spark):
    s = spark.createDataFrame([(i, None if i == 1 else f"u{i}", "phish" if i < 3 else None) for i in range(15)], "idx long, url string, label string")
    row = C.dataset_overview(s).first()
    assert row.samples == 15 and row.labels == {"phish": 3, "unknown": 12}
    assert row.examples == ["u0", "-", *[f"u{i}" for i in range(2, 10)]]
    empty = C.dataset_overview(s.limit(0)).first()
    assert (empty.samples, empty.examples, empty.labels) == (0, [], {})


def test_validation(spark):
    texts = ['{"url": "u", "label": "l"}', '{"url": "u"}', '{"label": null}', "{", None, "[1]", '{"label": "l"}']
    s = spark.createDataFrame(list(enumerate(texts)), "doc_id int, meta_json string")
    row = C.validate_samples(s).first()
    assert (row.total, row.missing_meta, row.missing_label, row.missing_url, row.valid) == (7, 1, 1, 2, False)
    assert [r.doc_id for r in C.problem_examples(s, "missing_label").collect()] == [1]
    assert C.validate_samples(s.filter("doc_id IN (0, 6)")).first().valid is True
