"""Mode-choice models on tabular features."""

from __future__ import annotations

import logging
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.vectors import argmax_class
from surveyalign.operators import metrics
from surveyalign.operators.boosting import SoftmaxTrees, fit_softmax_trees
from surveyalign.operators.features import TabularEncoder
from surveyalign.operators.sampling import sample_fewshot, split_test
from surveyalign.session import materialize

logger = logging.getLogger(__name__)

TASK_ROWS = 50_000       # distinct training rows per task


@dataclass
class ModeChoiceModel:
    """A fitted classifier with the medians and the classes of its training rows."""

    encoder: TabularEncoder
    classes: list[int]
    model: object
    clip_negatives: bool

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Add ``classes`` and ``proba``, aligned with each other."""
        features = F.array(*_inputs(df, self.encoder, self.clip_negatives))
        if isinstance(self.model, SoftmaxTrees):
            return df.select("*", F.lit(self.classes).alias("classes"), self.model.probabilities(features).alias("proba"))
        scored = self.model.transform(df.withColumn("_vector", array_to_vector(features)))
        return scored.select(*df.columns, F.lit(self.classes).alias("classes"), vector_to_array("probability").alias("proba"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).withColumn(
            "predicted_mode", argmax_class(F.col("classes"), F.col("proba")))


def _inputs(df: DataFrame, encoder: TabularEncoder, clip_negatives: bool) -> list:
    columns = encoder.imputed(df)
    return [F.greatest(c, F.lit(0.0)) for c in columns] if clip_negatives else columns


def _training_rows(df, encoder, classes, target, clip_negatives) -> DataFrame:
    """Stored distinct (vector, label) with their count as weight: the same likelihood on fewer rows."""
    label = (F.array_position(F.lit(classes), F.col(target)) - 1).cast("double")
    rows = df.where(F.col(target).isNotNull()).select(F.array(*_inputs(df, encoder, clip_negatives)).alias("vector"), label.alias("label"))
    return materialize(rows.groupBy("vector", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")), "training")


def _fit_parts(df: DataFrame, features: list[str], target: str):
    # The models impute every null by its median and keep the other codes as they are.
    encoder = TabularEncoder.fit(df, features, zero_unknown=False)
    # The label set is bounded by the code list.
    classes = sorted(r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().collect())
    return encoder, classes


def fit_mnl(
    df: DataFrame, features: list[str] = fv.MODEL_FEATURES, target: str = fv.TARGET_COLUMN, max_iter: int = 500
) -> ModeChoiceModel:
    """Unpenalised multinomial logit with intercept; negative features are set to 0."""
    encoder, classes = _fit_parts(df, features, target)
    stored = _training_rows(df, encoder, classes, target, clip_negatives=True)
    parts = max(1, math.ceil(stored.count() / TASK_ROWS))
    rows = stored.repartition(parts).select(array_to_vector("vector").alias("_vector"), "label", "weight").cache()
    try:
        model = LogisticRegression(
            family="multinomial", regParam=0.0, maxIter=max_iter, fitIntercept=True,
            featuresCol="_vector", labelCol="label", weightCol="weight").fit(rows)
    finally:
        rows.unpersist()
    return ModeChoiceModel(encoder, classes, model, clip_negatives=True)


def fit_boosted_trees(
    df: DataFrame,
    features: list[str] = fv.MODEL_FEATURES,
    target: str = fv.TARGET_COLUMN,
    n_estimators: int = 200,
    max_depth: int = 6,
    learning_rate: float = 0.1,
) -> ModeChoiceModel:
    """Boosted trees on the joint softmax loss: one tree per class and round, no random part."""
    encoder, classes = _fit_parts(df, features, target)
    rows = _training_rows(df, encoder, classes, target, clip_negatives=False)
    trees = fit_softmax_trees(rows, len(features), len(classes), n_estimators, max_depth, learning_rate)
    return ModeChoiceModel(encoder, classes, trees, clip_negatives=False)


def model_score(df: DataFrame, target: str = fv.TARGET_COLUMN) -> DataFrame:
    """Share of rows whose prediction is the target."""
    return df.agg(metrics.accuracy(target).alias("score"))


def baseline_grid(
    df: DataFrame,
    ratios: list[float] = fv.FEWSHOT_RATIOS,
    seeds: list[int] = [42],
    models: dict | None = None,
    concurrency: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Train on the few-shot rows and score the test rows for every model, ratio and seed.

    Returns (predictions, long metrics with n_train and n_test). The runs are independent Spark jobs and overlap.
    The test rows of a seed serve all its ratios and are drawn once. A run that fails is logged and has one metrics row, ``failed``, with the message in ``error``; ``error`` is
    null in all others. ``df`` should be a stored table.
    """
    models = models or {"mnl": fit_mnl, "boosted_trees": fit_boosted_trees}
    failures = []

    def run(ratio: float, seed: int) -> list[DataFrame]:
        test, rest = drawn[seed]
        train = materialize(sample_fewshot(rest, ratio, seed), "train")
        n_train = train.count()
        done = []
        for name, fit in models.items():
            try:
                predicted = fit(train).predict(test).withColumns({
                    "model": F.lit(name), "fewshot_ratio": F.lit(ratio), "seed": F.lit(seed), "n_train": F.lit(n_train)})
                done.append(materialize(predicted, "predictions"))
            except Exception as error:
                failures.append((name, ratio, seed, "failed", 1.0, f"{type(error).__name__}: {error}"))
                logger.exception("model %s failed at ratio %s, seed %s", name, ratio, seed)
        return done

    with ThreadPoolExecutor(concurrency) as pool:
        drawn = dict(zip(seeds, pool.map(lambda seed: split_test(df, seed=seed), seeds)))
        parts = [p for parts in pool.map(lambda rs: run(*rs), [(r, s) for r in ratios for s in seeds]) for p in parts]
    if not parts:
        raise RuntimeError("no model could be fitted")
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    keys = ["model", "fewshot_ratio", "seed"]
    cube = materialize(metrics.confusion_cube(predictions, keys), "cube")
    micro = metrics.evaluate_micro(cube, keys)
    macro = metrics.evaluate_macro(cube, keys)
    proba = metrics.unpivot(metrics.probability_metrics(predictions, keys), keys, ["nll", "brier_score"])
    sizes = predictions.groupBy(*keys).agg(F.first("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"))
    sizes = metrics.unpivot(sizes, keys, ["n_train", "n_test"])
    found = micro.unionByName(macro).unionByName(proba).unionByName(sizes).withColumn("error", F.lit(None).cast("string"))
    failed = df.sparkSession.createDataFrame(failures, "model string, fewshot_ratio double, seed int, metric string, value double, error string")
    return predictions.drop("n_train"), found.unionByName(failed)
