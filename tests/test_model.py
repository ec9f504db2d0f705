import random

import pytest
from pyspark.sql import functions as F

from pagesim.fixed_values import FEATURES
from pagesim.operators import model as M
from pagesim.operators import ordering as R
from pagesim.plans.training import train_pipeline


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(60):
        phish = i % 3 == 0
        values = {f: rng.gauss(2.0 if phish else 0.0, 0.5) for f in FEATURES}
        values["average_children_per_node"] = 1.0
        data.append((i, "phish" if phish else "legit", *values.values()))
    return spark.createDataFrame(data, "id long, label string, " + ", ".join(f"{f} double" for f in FEATURES))


@pytest.mark.parametrize("kind", [M.LOGISTIC, M.FOREST])
def test_train_save_load_predict(spark, rows, kind, tmp_path):
    model = M.create_model(kind)
    with pytest.raises(ValueError):
        model.predict(rows)
    with pytest.raises(ValueError):
        model.save(str(tmp_path / "m"))
    summary = model.train(rows)
    assert summary["n_samples"] == 60 and summary["n_features"] == 25 and summary["training_accuracy"] > 0.95
    model.save(str(tmp_path / "m"))
    loaded = M.PageModel.load(str(tmp_path / "m"))
    assert (loaded.model_type, loaded.features, loaded.n_samples) == (kind, FEATURES, 60)
    got = loaded.predict(rows).orderBy("id").collect()
    assert got == model.predict(rows).orderBy("id").collect()
    for r in got:
        assert r.ml_probability + r.ml_legit_probability == pytest.approx(1.0)
        assert r.ml_label == ("phish" if r.ml_probability > 0.5 else "legit")
        best = max(r.ml_probability, r.ml_legit_probability)
        assert r.ml_confidence == ("high" if best > 0.8 else "medium" if best > 0.6 else "low")


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        M.create_model("svm")
    with pytest.raises(Exception):
        M.PageModel.load(str(tmp_path / "missing"))


def test_three_rows(spark):
    data = [(1, *[float(i) for i in range(25)]), (0, *[0.0] * 25), (1, *[float(2 * i) for i in range(25)])]
    df = spark.createDataFrame(data, "label int, " + ", ".join(f"{f} double" for f in FEATURES))
    model = M.create_model()
    assert model.train(df)["n_samples"] == 3
    missing = df.withColumn("dom_entropy", F.lit(None).cast("double"))
    assert model.predict(missing).filter("ml_label IS NULL").count() == 0


def test_scaling_and_weights(spark, rows):
    scaled = M.scale(rows, ["dom_entropy", "average_children_per_node"])
    row = scaled.agg(F.avg("dom_entropy"), F.stddev_pop("dom_entropy"), F.max("average_children_per_node")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1) and row[2] == 0.0
    weights = {r.label: r.weight for r in M.balanced_weights(rows).select("label", "weight").distinct().collect()}
    assert weights == {"phish": 60 / 40, "legit": 60 / 80}


def test_metrics_with_zero_division(spark):
    none = spark.createDataFrame([(0, 0), (1, 0)], "y int, yhat int")
    assert tuple(M.classification_metrics(none).first()) == (0.5, 0.0, 0.0, 0.0)
    report = {r["class"]: r for r in M.classification_report(none).collect()}
    assert report["phish"].precision == 0.0 and report["legit"].recall == 1.0
    assert report["macro avg"].recall == 0.5 and report["weighted avg"].support == 2


def test_ordered_index_with_one_hot_class(spark):
    rng = random.Random(2)
    data = [(f"p{rng.random()}", "phish" if i % 10 else "legit") for i in range(500)]
    df = spark.createDataFrame(data, "path string, label string").repartition(7)
    got = R.ordered_index(df, ["path"], ["label"]).collect()
    for label in ("phish", "legit"):
        order = sorted(p for p, c in data if c == label)
        assert {r.path: r.idx for r in got if r.label == label} == {p: i for i, p in enumerate(order)}
    whole = R.ordered_index(df, [F.desc("path")]).collect()
    assert {r.path: r.idx for r in whole} == {p: i for i, p in enumerate(sorted((p for p, _ in data), reverse=True))}


def test_stratified_split(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30, "phish").otherwise("legit").alias("label"))
    split = R.stratified_split(df)
    counts = {(r.label, r.is_test): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    assert counts == {("phish", True): 6, ("phish", False): 24, ("legit", True): 34, ("legit", False): 136}
    assert R.stratified_split(df).orderBy("doc_id").collect() == split.orderBy("doc_id").collect()
    assert R.stratified_split(df, 0).filter("NOT is_test").count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    def page(phish):
        tags = ["form", "input", "script"] if phish else ["p", "a", "div", "article"]
        return "<html>" + "".join(f"<{t}>x</{t}>" for t in rng.choices(tags, k=20)) + "</html>"
    data = [(i, page(i % 2), "phish" if i % 2 else "legit") for i in range(40)]
    df = spark.createDataFrame(data, "page_id long, html string, label string")
    _, summary, metrics = train_pipeline(df, path=str(tmp_path / "model"))
    assert summary["n_samples"] == 32 and metrics.first().accuracy == 1.0
    with pytest.raises(ValueError):
        train_pipeline(df.limit(9))


def test_missing_groups_are_groups_of_their_own(spark):
    rows = [(1, "a"), (2, None), (3, None), (4, "a"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    placed = R.ordered_index(df, ["doc_id"], ["label"]).collect()
    assert sorted((r.doc_id, r.label, r.idx) for r in placed if r.label) == [(1, "a", 0), (4, "a", 1)]
    assert sorted((r.doc_id, r.idx) for r in placed if not r.label) == [(2, 0), (3, 1), (5, 2)]
    split = R.stratified_split(df, 0.5).collect()
    assert len(split) == 5 and sum(r.is_test for r in split if r.label) == 1
