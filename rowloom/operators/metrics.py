"""Scores of multi-label predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.order import running_sums
from rowloom.session import materialize


def exact_match(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of rows whose whole label vector is predicted right."""
    hit = F.col(truth).eqNullSafe(F.col(predicted)).cast("int")
    return df.agg(F.avg(hit).alias("accuracy"))


def ranking_scores(df: DataFrame, label: str, score: str, truth: str) -> DataFrame:
    """ROC-AUC and average precision per label from (label, score, truth 0/1) rows.

    Rows with equal scores are one step: half a win each for the ROC area, one
    threshold for the precision steps. They are counted together first, and the
    running counts are sorted in many tasks, so one label may hold most rows.
    A label with one class only has no ROC-AUC; without positives its average
    precision is 0.
    """
    step = df.groupBy(F.col(label).alias("label"), (-F.col(score)).alias("_down")).agg(
        F.sum(F.col(truth)).cast("bigint").alias("p"),
        F.sum(1 - F.col(truth)).cast("bigint").alias("n"),
    )
    running = running_sums(materialize(step, "scores"), "_down", ["p", "n"], ["label"])
    wins = F.sum(F.col("n") * (F.col("run_p") - F.col("p") / 2))
    pairs = F.sum("p").cast("double") * F.sum("n")
    precision = F.col("run_p") / (F.col("run_p") + F.col("run_n"))
    return running.groupBy("label").agg(
        F.try_divide(wins, pairs).alias("roc_auc"),
        F.coalesce(F.try_divide(F.sum(F.col("p") * precision), F.sum("p")), F.lit(0.0)).alias("avg_precision"),
    )


def macro_mean(scores: DataFrame) -> DataFrame:
    """Plain mean over the labels."""
    return scores.agg(
        F.avg("roc_auc").alias("macro_roc_auc"), F.avg("avg_precision").alias("macro_avg_precision")
    )
