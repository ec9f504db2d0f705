"""C11: pages with labels to a trained, evaluated and saved model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MIN_TRAINING_SAMPLES
from ..functions.verdicts import label_to_int
from ..operators.features import page_features
from ..operators.model import LOGISTIC, classification_metrics, create_model
from ..operators.ordering import stratified_split
from ..session import materialize


def train_pipeline(samples: DataFrame, cluster_protos: DataFrame | None = None,
                   model_type: str = LOGISTIC, test_fraction: float = 0.2, seed: int = 42,
                   id_col: str = "page_id", path: str | None = None, distance: str = "ncd") -> tuple:
    """``samples(<id_col>, html, label)`` to (model, training summary, test metrics or None).

    Training and detection share one feature function over raw pages. Features are costly, so
    they are computed once and written before the split reads them twice."""
    features = page_features(samples, cluster_protos, key=id_col, distance=distance)
    features = materialize(features, "features")
    if features.limit(MIN_TRAINING_SAMPLES).count() < MIN_TRAINING_SAMPLES:
        raise ValueError(f"need at least {MIN_TRAINING_SAMPLES} samples for training")
    split = stratified_split(features, test_fraction, seed, id_col)
    train = split if not test_fraction else split.filter(~F.col("is_test"))
    model = create_model(model_type)
    summary = model.train(train.drop("is_test"))
    metrics = None
    if test_fraction:
        scored = model.predict(split.filter("is_test").drop("is_test"))
        metrics = classification_metrics(scored.select(
            label_to_int(F.col("label")).alias("y"), label_to_int(F.col("ml_label")).alias("yhat")))
    if path:
        model.save(path)
    return model, summary, metrics
