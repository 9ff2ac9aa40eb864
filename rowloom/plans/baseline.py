"""Multi-label baseline: split, fit, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators import model
from rowloom.operators.metrics import exact_match, macro_mean, ranking_scores
from rowloom.session import materialize


@dataclass
class Baseline:
    """Predictions on all rows, the scores, and the validation loss by round.

    predictions (id, is_test, y, probability, predicted); train_accuracy and
    test_accuracy (accuracy); per_label (label, n, roc_auc, avg_precision) and macro of
    the test rows; curves (label, round, loss, kept): whether a round is in the model.
    """

    predictions: DataFrame
    train_accuracy: DataFrame
    test_accuracy: DataFrame
    per_label: DataFrame
    macro: DataFrame
    curves: DataFrame


def baseline(
    features: DataFrame, labelled: DataFrame, id_col: str, *, rounds: int = 500, max_depth: int = 6, patience: int = 2
) -> Baseline:
    """Fit one model per label on (id, features) and (id, labels).

    A fifth of the ids is held out for testing; a tenth of the others decides
    when boosting stops.
    """
    classes = model.class_list(labelled, "labels")
    rows = model.join_features(features, model.binarize(labelled, "labels", classes), id_col)
    rows = rows.withColumn("is_test", model.hash_split(id_col, 20)).withColumn(
        "is_validation", model.hash_split(id_col, 10, seed=1)
    )
    rows = materialize(rows, "rows")
    fitted = model.fit_labels(
        rows.filter(~F.col("is_test")), "features", "y", len(classes),
        validation="is_validation", rounds=rounds, max_depth=max_depth, patience=patience,
    )
    models = [one.model for one in fitted]
    curves = [
        (label, i, loss, i <= one.rounds) for label, one in zip(classes, fitted) for i, loss in enumerate(one.curve, 1)
    ]
    predictions = materialize(
        model.predict_labels(rows, models, "features").select(id_col, "is_test", "y", "probability", "predicted"),
        "predictions",
    )
    test = predictions.filter("is_test")
    scores = model.label_scores(test, id_col, "y", "probability", classes)
    per_label = ranking_scores(scores, "label", "score", "truth")
    return Baseline(
        predictions,
        exact_match(predictions.filter(~F.col("is_test")), "y", "predicted"),
        exact_match(test, "y", "predicted"),
        per_label,
        macro_mean(per_label),
        rows.sparkSession.createDataFrame(curves, "label string, round int, loss double, kept boolean"),
    )
