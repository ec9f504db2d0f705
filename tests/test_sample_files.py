import os

import pytest
from pyspark.sql import functions as F

from pagesim.sources import readers
from pagesim.sources.sample_files import read_manifest, read_sample_files, write_sample_files

SCHEMA = "folder string, stem string, dom binary, url string, ts long, size long, label string"
ROWS = [("", "a", b"html body", "http://a", 5, 9, "phish"), ("", "b", b"", None, None, None, None), ("", "é ü", b"p", "http://c", 6, 1, None)]


def names(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files if not f.startswith("."))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "samples")
    write_sample_files(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path)
    out = {r.stem: r for r in read_sample_files(spark, path).collect()}
    assert [(out[s].dom, out[s].has_meta, out[s].url, out[s].ts, out[s].size, out[s].label) for s in ("a", "b", "é ü")] == [
        (b"html body", True, "http://a", 5, 9, "phish"), (b"", False, None, None, None, None), (b"p", True, "http://c", 6, 1, None)]
    assert sorted(map(tuple, read_manifest(spark, path).collect())) == [
        ("a.dom", "a.meta.json", "phish"), ("b.dom", "b.meta.json", "unknown"), ("é ü.dom", "é ü.meta.json", "unknown")]
    assert not os.path.exists(f"{path}/_temporary")


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "samples")
    df = spark.createDataFrame(ROWS, SCHEMA)
    write_sample_files(df.where("stem = 'a'"), path)
    write_sample_files(df.where("stem = 'b'"), path)
    assert {r.stem for r in read_sample_files(spark, path).collect()} == {"a", "b"} and read_manifest(spark, path).count() == 2
    (tmp_path / "samples" / "notes.txt").write_text("mine")
    write_sample_files(df.where("stem = 'b'"), path, "overwrite")
    assert {r.stem for r in read_sample_files(spark, path).collect()} == {"b"} and read_manifest(spark, path).count() == 1
    assert (tmp_path / "samples" / "notes.txt").exists()


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "samples")
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    bad = df.withColumn("stem", F.when(F.col("stem") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("stem")))
    with pytest.raises(Exception, match="broken"):
        write_sample_files(bad, path)
    assert names(path) == []


def test_both_engines_read_the_same(spark, tmp_path):
    path = str(tmp_path / "samples")
    write_sample_files(spark.createDataFrame(ROWS, SCHEMA), path)
    (tmp_path / "samples" / "b.meta.json").write_text("[1]")
    (tmp_path / "samples" / "lonely.meta.json").write_text('{"label": "phish"}')
    def rows(engine):
        return sorted((r.stem, r.url, r.label, bytes(r.dom), r.source.ts) for r in readers.read_samples_sidecar(spark, path, engine).collect())
    assert rows("files") == [("a", "http://a", "phish", b"html body", 5), ("é ü", "http://c", "legit", b"p", 6)]
    assert [r for r in rows("spark") if r[0] != "b"] == rows("files")


def test_folders(spark, tmp_path):
    path = str(tmp_path / "dirs")
    rows = [("phishing", "x", b"p", None, None, None, None), ("legit", "y", b"", None, None, None, None), ("other", "z", b"q", None, None, None, None)]
    write_sample_files(spark.createDataFrame(rows, SCHEMA), path)
    got = sorted((r.stem, r.url, r.label, bytes(r.dom)) for r in readers.read_samples_labelled_dirs(spark, path, "files").collect())
    assert got == [("x", "x", "phish", b"p"), ("y", "y", "legit", b"")]
    sets = {"one": f"{path}/phishing", "two": f"{path}/legit", "none": f"{path}/absent"}
    assert [(r.proto_set, r.stem) for r in readers.read_prototype_sets(spark, sets, "files").collect()] == [("one", "x")]
    assert read_sample_files(spark, f"{path}/absent").count() == 0


def test_files_are_dealt_by_number_and_bytes(spark, tmp_path, monkeypatch):
    from pagesim.sources import sample_files as S
    for i in range(25):
        (tmp_path / f"f{i:02d}.dom").write_bytes(b"x" * (100 if i else 1000))
    monkeypatch.setattr(S, "FILES_PER_PARTITION", 10)
    monkeypatch.setattr(S, "BYTES_PER_PARTITION", 1500)
    parts = S.SampleFilesReader({"path": str(tmp_path)}).partitions()
    assert [len(p.files) for p in parts] == [6, 10, 9] and sum(len(p.files) for p in parts) == 25
