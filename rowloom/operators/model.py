"""Multi-label baseline: label vectors, split, boosted trees, probabilities."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.arrays import cast_vector, indicator
from rowloom.functions.text import md5_number
from rowloom.operators.order import dense_order, null_safe_join
from rowloom.session import discard, materialize


def label_classes(df: DataFrame, labels: str) -> DataFrame:
    """The sorted distinct labels with their index: (label, index)."""
    distinct = df.select(F.explode(labels).alias("label")).dropna().distinct()
    return dense_order(distinct, "label", name="index")


def class_list(df: DataFrame, labels: str, most: int = 10_000) -> list[str]:
    """The sorted distinct labels, without NULL, as the column order of a label matrix.

    The matrix has a column, and the baseline a model, for each of them; more
    than ``most`` are refused, and ``label_indices`` is for such label sets.
    """
    found = df.select(F.explode(labels).alias("label")).dropna().distinct().orderBy("label").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} labels; use label_indices")
    return [row[0] for row in found]


def binarize(df: DataFrame, labels: str, classes: list[str], out: str = "y") -> DataFrame:
    """0/1 vector per row over the classes; an empty list gives zeros."""
    return df.withColumn(out, indicator(labels, classes))


def label_indices(df: DataFrame, id_col: str, labels: str) -> DataFrame:
    """The ones of the label matrix, long form (id, index), for any number of classes."""
    pairs = df.select(id_col, F.explode(F.array_distinct(labels)).alias("label"))
    return pairs.distinct().join(label_classes(df, labels), "label").select(id_col, "index")


def join_features(features: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """One row per entity with its features and its labels, matched on the id."""
    return null_safe_join(features, labels, [id_col])


def hash_split(id_col: Column | str, percent: int = 20, seed: int | None = None) -> Column:
    """True for about ``percent`` of the ids; the same ids on every run."""
    value = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    if seed is not None:
        value = F.concat(value, F.lit(str(seed)))
    return F.pmod(md5_number(value), F.lit(100)) < percent


#: Hexadecimal digits of a split's hash, and those that one round of its search fixes.
SPLIT_DIGITS, ROUND_DIGITS = 15, 3


def exact_split(df: DataFrame, id_col: str, percent: int = 20, seed: int | None = None, out: str = "is_test") -> DataFrame:
    """Adds ``out``: true for exactly ceil(percent * n / 100) of the n distinct ids, those with the least md5; repeatable.

    Rows of one id stay together; a NULL id is an id. The hash of the last id that belongs to the part is found digit by
    digit: each round counts the ids by their next three digits within the
    prefix found so far, so the driver sees at most 4096 counts and nothing is sorted.
    """
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("\x00"))
    mixed = F.substring(F.md5(text if seed is None else F.concat(text, F.lit(str(seed)))), 1, SPLIT_DIGITS)
    hashes = materialize(df.select(text.alias("id"), mixed.alias("hash")).distinct(), "hashes")
    left = -(-percent * hashes.count() // 100)
    chosen, prefix, tied = F.lit(False), "", []
    if left:
        while len(prefix) < SPLIT_DIGITS:
            end = len(prefix) + ROUND_DIGITS
            counts = hashes.filter(F.col("hash").startswith(prefix)).groupBy(F.substring("hash", 1, end).alias("head")).count().collect()
            for head, n in sorted(map(tuple, counts)):
                if left <= n:
                    prefix = head
                    break
                left -= n
        tied = [r["id"] for r in hashes.filter(F.col("hash") == prefix).orderBy("id").limit(left).collect()]
        chosen = (mixed < prefix) | ((mixed == prefix) & text.isin(*tied))
    discard(hashes)
    return df.withColumn(out, chosen)


@dataclass
class Boosted:
    """A model cut at its best round, and the validation loss after every round tried."""

    model: GBTClassificationModel
    rounds: int
    curve: list[float]


def best_round(curve: list[float], patience: int) -> tuple[int, bool]:
    """The round with the least loss, and whether ``patience`` rounds behind it in a row bring no gain."""
    least, at = float("inf"), 0
    for i, loss in enumerate(curve, 1):
        if loss < least:
            least, at = loss, i
        elif i - at >= patience:
            return at, True
    return at, False


def fit_labels(
    df: DataFrame,
    features: str,
    truth: str,
    n_labels: int,
    *,
    validation: str,
    rounds: int = 500,
    learning_rate: float = 0.1,
    max_depth: int = 6,
    patience: int = 2,
    first: int = 8,
    seed: int = 0,
    at_once: int = 4,
) -> list[Boosted]:
    """One boosted-tree model per label, stopped when ``patience`` rounds in a row do not make the validation rows better.

    An ensemble of ``first`` rounds gives the validation loss after each of them in one
    pass over the validation rows; it is fitted with twice the rounds, up to ``rounds``, until the curve has
    stopped falling, and then cut behind the best. Every fit draws the same trees, so labels
    that come later begin with the rounds that most of the earlier ones needed, without a change of the result. Without
    validation rows boosting takes all rounds. The table is cached
    once and shared by all fits, of which ``at_once`` run side by side.
    """
    vectors = df.select(
        array_to_vector(cast_vector(features, "double")).alias("_x"),
        truth,
        F.col(validation).alias("_val"),
    ).persist()
    needed: list[int] = []

    def fit(i: int) -> Boosted:
        rows = vectors.select("_x", "_val", F.col(truth)[i].cast("double").alias("_y"))
        learned, held = rows.filter(~F.col("_val")), rows.filter("_val")

        def ensemble(size: int) -> GBTClassificationModel:
            trees = GBTClassifier(
                featuresCol="_x", labelCol="_y", maxIter=size, stepSize=learning_rate, maxDepth=max_depth, seed=seed
            )
            return trees.fit(learned)

        size, curve = min(first_size(first, needed, patience), rounds) if checked else rounds, []
        model = ensemble(size)
        while checked:
            curve = model.evaluateEachIteration(held)
            best, stopped = best_round(curve, patience)
            if stopped or size >= rounds:
                needed.append(min(best + patience, size))
                model = model if best == size else cut_ensemble(model, max(1, best))
                break
            size = min(2 * size, rounds)
            model = ensemble(size)
        return Boosted(model, len(model.treeWeights), curve)

    try:
        checked = not vectors.filter("_val").isEmpty()
        with ThreadPoolExecutor(at_once) as pool:
            return list(pool.map(inheritable_thread_target(df.sparkSession)(fit), range(n_labels)))
    finally:
        vectors.unpersist()


def first_size(first: int, needed: list[int], patience: int) -> int:
    """Rounds of a label's first ensemble: what three quarters of the ``needed`` were enough for, and ``patience`` more."""
    if not needed:
        return first
    return max(first, sorted(needed)[(3 * len(needed) - 1) // 4] + patience)


def cut_ensemble(model: GBTClassificationModel, size: int) -> GBTClassificationModel:
    """The first ``size`` trees of a model, which is what a fit of that many rounds gives."""
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, size)
    weights = gateway.new_array(gateway.jvm.double, size)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:size], list(java.treeWeights())[:size])):
        trees[i], weights[i] = tree, weight
    cut = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights)
    made = GBTClassificationModel(cut)
    model._copyValues(made)
    made._transfer_params_to_java()
    return made


def predict_labels(df: DataFrame, models: list[GBTClassificationModel], features: str) -> DataFrame:
    """Add ``probability`` and the 0/1 vector ``predicted``, one entry per label.

    The models run one after the other over the same rows: no join, no shuffle.
    """
    scored = df.withColumn("_x", array_to_vector(cast_vector(features, "double")))
    for i, model in enumerate(models):
        model = model.copy()
        model.setFeaturesCol("_x").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p")
        scored = model.transform(scored).withColumn(f"_p{i}", vector_to_array("_p")[1]).drop("_p")
    names = [f"_p{i}" for i in range(len(models))]
    return (
        scored.withColumn("probability", F.array(*names))
        .withColumn("predicted", F.transform("probability", lambda p: (p > 0.5).cast("int")))
        .drop("_x", *names)
    )


def label_scores(df: DataFrame, id_col: str, truth: str, probability: str, classes: list[str]) -> DataFrame:
    """One row per entity and label: (id, label, truth, score)."""
    names = F.array(*[F.lit(name) for name in classes])
    zipped = F.arrays_zip(names.alias("label"), F.col(truth).alias("truth"), F.col(probability).alias("score"))
    return df.select(id_col, F.explode(zipped).alias("_z")).select(
        id_col, F.col("_z.label").alias("label"), F.col("_z.truth").alias("truth"), F.col("_z.score").alias("score")
    )
