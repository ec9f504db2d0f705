"""Classifier over the page features, on MLlib.

Scaling is a SQL stage of the pipeline model, so one saved model holds it all."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import FEATURES
from ..functions.verdicts import int_to_label, label_to_int, ml_confidence_band

# Model settings.
LOGISTIC = "logistic_regression"
FOREST = "random_forest"
MAX_ITERATIONS = 1000
TREES = 100
TREE_DEPTH = 10
SEED = 42

_DETAILS = T.StructType([
    T.StructField("model_type", T.StringType()),
    T.StructField("feature_order", T.ArrayType(T.StringType())),
    T.StructField("n_samples", T.LongType()),
])


def scaling(df: DataFrame, features=FEATURES) -> dict[str, tuple[float, float]]:
    """C4: mean and population standard deviation per feature, in one pass."""
    row = df.agg(*[a for f in features for a in (
        F.avg(F.coalesce(f, F.lit(0.0))).alias(f"m_{f}"),
        F.stddev_pop(F.coalesce(f, F.lit(0.0))).alias(f"s_{f}"))]).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"]) for f in features}


def scale(df: DataFrame, features=FEATURES) -> DataFrame:
    """Features as zero mean and unit population deviation; missing counts as 0.0 and a
    constant feature becomes 0."""
    stats = scaling(df, features)
    return df.withColumns({
        f: (F.coalesce(f, F.lit(0.0)) - stats[f][0]) / (stats[f][1] or 1.0) for f in features})


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_class"))
    totals = {r[label]: r["_class"] for r in counts.collect()}  # one row per class
    n = sum(totals.values())
    weight = F.lit(None).cast("double")
    for value, size in totals.items():
        weight = F.when(F.col(label) == value, n / (len(totals) * size)).otherwise(weight)
    return df.withColumn("weight", weight)


class PageModel:
    """One classifier with its scaling and feature order."""

    def __init__(self, model_type: str = LOGISTIC, features=FEATURES):
        if model_type not in (LOGISTIC, FOREST):
            raise ValueError(f"no model type {model_type!r}; there are {LOGISTIC!r} and {FOREST!r}")
        self.model_type = model_type
        self.features = list(features)
        self.pipeline: PipelineModel | None = None
        self.n_samples = 0

    def train(self, df: DataFrame, label: str = "label") -> dict[str, float]:
        """Fit on ``label`` in {phish, legit} or {1, 0}; gives the training summary.

        The penalty matches an L2 strength of C=1 under balanced weights, which sum to n."""
        is_text = isinstance(df.schema[label].dataType, T.StringType)
        target = label_to_int(F.col(label)) if is_text else F.col(label)
        rows = balanced_weights(df.withColumn("_y", target.cast("double")), "_y").persist()
        try:
            self.n_samples = rows.count()
            stats = scaling(rows, self.features)
            scaled = ", ".join(
                f"(coalesce({f}, 0D) - {m!r}D) / {(s or 1.0)!r}D AS x_{f}" for f, (m, s) in stats.items())
            scaler = SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")
            vector = VectorAssembler(inputCols=[f"x_{f}" for f in self.features], outputCol="_x")
            ready = vector.transform(scaler.transform(rows))
            if self.model_type == LOGISTIC:
                estimator = LogisticRegression(
                    featuresCol="_x", labelCol="_y", weightCol="weight", maxIter=MAX_ITERATIONS,
                    regParam=1.0 / self.n_samples, elasticNetParam=0.0, standardization=False,
                    rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_prediction")
            else:
                estimator = RandomForestClassifier(
                    featuresCol="_x", labelCol="_y", weightCol="weight", numTrees=TREES,
                    maxDepth=TREE_DEPTH, seed=SEED, featureSubsetStrategy="sqrt",
                    rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_prediction")
            fitted = estimator.fit(ready)
            self.pipeline = PipelineModel([scaler, vector, fitted])
            accuracy = fitted.transform(ready).agg(
                F.avg((F.col("_prediction") == F.col("_y")).cast("double"))).first()[0]
        finally:
            rows.unpersist()
        return {"training_accuracy": accuracy, "n_samples": self.n_samples,
                "n_features": len(self.features)}

    def predict(self, df: DataFrame, prefix: str = "ml_") -> DataFrame:
        """Add label, probability (of phish), legit_probability and confidence."""
        if self.pipeline is None:
            raise ValueError("predicting needs a trained or loaded model")
        out = self.pipeline.transform(df)
        p = vector_to_array("_p")
        out = out.withColumns({
            f"{prefix}label": int_to_label(F.col("_prediction")),
            f"{prefix}probability": F.get(p, F.lit(1)), f"{prefix}legit_probability": F.get(p, F.lit(0))})
        out = out.withColumn(f"{prefix}confidence", ml_confidence_band(
            F.col(f"{prefix}probability"), F.col(f"{prefix}legit_probability")))
        return out.drop("_x", "_raw", "_p", "_prediction", *[f"x_{f}" for f in self.features])

    def save(self, path: str) -> None:
        """K8."""
        if self.pipeline is None:
            raise ValueError("there is nothing to save before training")
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        details = [(self.model_type, self.features, self.n_samples)]
        spark.createDataFrame(details, _DETAILS).coalesce(1).write.mode("overwrite").json(f"{path}/details")

    @classmethod
    def load(cls, path: str) -> PageModel:
        """K8: a missing path is an error."""
        spark = SparkSession.getActiveSession()
        details = spark.read.schema(_DETAILS).json(f"{path}/details").first()
        model = cls(details["model_type"], details["feature_order"])
        model.n_samples = details["n_samples"]
        model.pipeline = PipelineModel.load(f"{path}/pipeline")
        return model


def create_model(model_type: str = LOGISTIC) -> PageModel:
    """C8."""
    return PageModel(model_type)


def _ratio(top, bottom):
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def classification_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; a zero division gives 0."""
    counts = df.agg(
        F.count("*").alias("n"), F.count_if(F.col(y) == F.col(yhat)).alias("right"),
        F.count_if((F.col(y) == 1) & (F.col(yhat) == 1)).alias("tp"),
        F.count_if(F.col(yhat) == 1).alias("said"), F.count_if(F.col(y) == 1).alias("true"))
    return counts.select(
        _ratio(F.col("right"), F.col("n")).alias("accuracy"),
        _ratio(F.col("tp"), F.col("said")).alias("precision"),
        _ratio(F.col("tp"), F.col("true")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("said") + F.col("true")).alias("f1_score"))


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    sides = df.select(F.explode(F.array(
        F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("s"),
                 (F.col(y) == F.col(yhat)).cast("int").alias("tp")),
        F.struct(F.col(yhat).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("s"), F.lit(0).alias("tp")),
    )).alias("x"))
    per = sides.groupBy(F.col("x.c").alias("c")).agg(
        F.sum("x.t").alias("support"), F.sum("x.s").alias("said"), F.sum("x.tp").alias("tp"))
    per = per.select(
        F.when(F.col("c") == 1, "phish").otherwise("legit").alias("class"),
        _ratio(F.col("tp"), F.col("said")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1_score"), "support")
    scores = ["precision", "recall", "f1_score"]
    averages = per.agg(
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(f"weighted_{s}") for s in scores],
        F.sum("support").alias("support"))
    for kind in ("macro", "weighted"):
        per = per.unionByName(averages.select(
            F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{s}").alias(s) for s in scores], "support"))
    return per
