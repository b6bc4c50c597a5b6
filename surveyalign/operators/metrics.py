"""Scores of predictions, per record and as population shares.

Everything without probabilities derives from one aggregate: row counts and weights per
(run, true mode, predicted mode, subgroup codes). It combines before the shuffle, its size
is bounded by the code lists, and the metrics below only read that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.vectors import align_proba
from surveyalign.operators.filters import filter_valid_predictions
from surveyalign.session import materialize


def confusion_cube(
    df: DataFrame,
    keys: list[str] = [],
    subgroups: list[str] = [],
    truth: str = fv.TARGET_COLUMN,
    prediction: str = "predicted_mode",
    weight: str | None = "trip_weight",
) -> DataFrame:
    """Rows ``n`` and weight ``w`` per keys, subgroup codes, true and predicted label."""
    w = F.col(weight).cast("double") if weight and weight in df.columns else F.lit(1.0)
    groups = [F.col(c) for c in [*keys, *subgroups]]
    return df.groupBy(
        *groups, F.col(truth).alias("y_true"), F.col(prediction).alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))


def confusion_counts(df: DataFrame, keys: list[str] = [], **columns) -> DataFrame:
    return confusion_cube(df, keys, weight=None, **columns).drop("w")


# ---- Per record -----------------------------------------------------------------------

def per_class_prf(cube: DataFrame, keys: list[str] = []) -> DataFrame:
    """Support, precision, recall and F1 of every label that is true or predicted somewhere."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"),
                 none.alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("y_pred").alias("label"), none.alias("support"),
                 F.col("n").alias("predicted"), none.alias("hits")),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        cube.select(*keys, F.inline(sides))
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
        .withColumns({
            "precision": ratio(F.col("hits"), F.col("predicted")),
            "recall": ratio(F.col("hits"), F.col("support")),
            "f1": ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")),
        })
    )


def micro_metrics(cube: DataFrame, keys: list[str] = []) -> DataFrame:
    """Accuracy, macro F1 over all occurring labels, F1 weighted by true support."""
    return per_class_prf(cube, keys).groupBy(*keys).agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def accuracy(truth: str = fv.TARGET_COLUMN, prediction: str = "predicted_mode") -> Column:
    """Share of exact matches, as an aggregate expression."""
    return F.avg((F.col(truth) == F.col(prediction)).cast("double"))


def negative_log_likelihood(aligned: Column, truth: Column, labels: list[int] = fv.MODES) -> Column:
    """-ln of the true label's probability, clipped; an unlisted label counts as the first one."""
    position = _label_position(truth, labels)
    return -F.log(F.greatest(F.get(aligned, position), F.lit(fv.NLL_EPSILON)))


def brier(aligned: Column, truth: Column, labels: list[int] = fv.MODES) -> Column:
    """Squared distance between the probabilities and the one-hot truth."""
    position = _label_position(truth, labels)
    gaps = [F.get(aligned, F.lit(i)) - (position == i).cast("double") for i in range(len(labels))]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def _label_position(truth: Column, labels: list[int]) -> Column:
    position = F.lit(0)
    for i, label in enumerate(labels):
        position = F.when(truth == label, F.lit(i)).otherwise(position)
    return position


def probability_metrics(
    df: DataFrame, keys: list[str] = [], classes: str = "classes", proba: str = "proba",
    truth: str = fv.TARGET_COLUMN,
) -> DataFrame:
    """Mean negative log-likelihood and Brier score of the aligned probabilities."""
    return align_proba(df, classes, proba, "_aligned").groupBy(*keys).agg(
        F.avg(negative_log_likelihood(F.col("_aligned"), F.col(truth))).alias("nll"),
        F.avg(brier(F.col("_aligned"), F.col(truth))).alias("brier_score"),
    )


# ---- Population shares ----------------------------------------------------------------

def _array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def share_arrays(cube: DataFrame, keys: list[str] = [], codes: list[int] = fv.MODES) -> DataFrame:
    """Per key the true shares, by weight, and the predicted shares, by row, in code order."""
    def weights(label: str, value: Column) -> Column:
        return F.array(*[
            F.coalesce(F.sum(F.when(F.col(label) == c, value)), F.lit(0)).cast("double") for c in codes])

    def shares(values: str, total: str) -> Column:
        return F.transform(values, lambda v: F.when(F.col(total) == 0, 0.0).otherwise(F.try_divide(v, F.col(total))))

    totals = cube.groupBy(*keys).agg(
        weights("y_true", F.col("w")).alias("_true"), weights("y_pred", F.col("n")).alias("_pred"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("_w"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n_trips"),
    )
    return totals.select(
        *keys, F.col("n_trips").cast("bigint").alias("n_trips"),
        shares("_true", "_w").alias("true_share"), shares("_pred", "n_trips").alias("pred_share"))


def share_mae(true_share: Column, pred_share: Column) -> Column:
    gaps = F.zip_with(true_share, pred_share, lambda t, p: F.abs(t - p))
    return _array_sum(gaps) / F.size(gaps)


def share_js(p: Column, q: Column, p_total: Column, q_total: Column) -> Column:
    """Jensen-Shannon distance (square root, natural logarithm) of two arrays over their totals."""
    def term(x, y):
        a, b = x / p_total, y / q_total
        return a * F.log(2 * a / (a + b)) + b * F.log(2 * b / (a + b))

    return F.sqrt(F.greatest(_array_sum(F.zip_with(p, q, term)), F.lit(0.0)) / 2)


def macro_metrics(cube: DataFrame, keys: list[str] = [], codes: list[int] = fv.MODES) -> DataFrame:
    """Mean absolute error and Jensen-Shannon distance of the shares, with the shares.

    The distance is taken of the shares raised by a small constant and renormalised.
    """
    raised = lambda name: F.transform(name, lambda x: x + F.lit(fv.JS_SMOOTHING))
    smoothed = (
        share_arrays(cube, keys, codes)
        .withColumns({"_p": raised("true_share"), "_q": raised("pred_share")})
        .withColumns({"_pt": _array_sum(F.col("_p")), "_qt": _array_sum(F.col("_q"))})
    )
    return smoothed.withColumns({
        "mode_share_mae": share_mae(F.col("true_share"), F.col("pred_share")),
        "mode_share_js": share_js(F.col("_p"), F.col("_q"), F.col("_pt"), F.col("_qt")),
    }).drop("_p", "_q", "_pt", "_qt")


def share_gaps(macro: DataFrame, keys: list[str] = [], codes: list[int] = fv.MODES) -> DataFrame:
    """One row per code: predicted minus true share, and both."""
    rows = F.arrays_zip(
        F.array(*[F.lit(c) for c in codes]).alias("mode"), F.col("true_share"), F.col("pred_share"))
    return (
        macro.select(*keys, F.inline(rows))
        .withColumn("share_gap", F.col("pred_share") - F.col("true_share"))
    )


def subgroup_macro(
    cube: DataFrame, subgroups: list[str] = fv.SUBGROUP_COLUMNS, keys: list[str] = []
) -> DataFrame:
    """Rows, share error and share distance of every value of every subgroup column."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("subgroup"), F.col(c).cast("int").alias("subgroup_value")) for c in subgroups])
    tall = cube.select(*keys, "y_true", "y_pred", "n", "w", F.inline(pairs)).where(
        F.col("subgroup_value").isNotNull())
    by = [*keys, "subgroup", "subgroup_value"]
    return macro_metrics(tall, by).select(*by, "n_trips", "mode_share_mae", "mode_share_js")


def attribute_share_mae(
    df: DataFrame, attributes: dict[str, tuple[str, list[int]]], keys: list[str] = [],
    weight: str | None = "trip_weight",
) -> DataFrame:
    """Share error of other coded attributes: {true column: (predicted column, codes)}.

    All attributes are tallied in one pass over the rows.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    aggregates = []
    for truth, (prediction, codes) in attributes.items():
        true_w = F.array(*[F.sum(F.when(F.col(truth) == c, w).otherwise(0.0)) for c in codes])
        pred_n = F.array(*[F.count_if(F.col(prediction) == c).cast("double") for c in codes])
        aggregates.append((truth, true_w, pred_n))
    totals = df.groupBy(*keys).agg(
        F.sum(w).alias("_w"), F.count(F.lit(1)).cast("double").alias("_n"),
        *[t.alias(f"_true_{name}") for name, t, _ in aggregates],
        *[p.alias(f"_pred_{name}") for name, _, p in aggregates],
    )
    share = lambda values, total: F.transform(
        values, lambda v: F.coalesce(F.try_divide(v, F.col(total)), F.lit(0.0)))
    rows = F.array(*[
        F.struct(F.lit(name).alias("attribute"),
                 share_mae(share(f"_true_{name}", "_w"), share(f"_pred_{name}", "_n")).alias("share_mae"))
        for name in attributes
    ])
    return totals.select(*keys, F.inline(rows))


# ---- Long tables ----------------------------------------------------------------------

def _metric_name(prefix: str, code: Column) -> Column:
    label = code.cast("string")
    for mode, name in fv.MODE_LABELS.items():
        label = F.when(code == mode, F.lit(name.replace(" ", "_"))).otherwise(label)
    return F.concat(F.lit(prefix), label)


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.inline(rows))


def evaluate_micro(cube: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, metric, value): accuracy, F1 averages, precision, recall and F1 per true label."""
    averages = unpivot(micro_metrics(cube, keys), keys, ["accuracy", "macro_f1", "weighted_f1"])
    rows = F.array(*[
        F.struct(_metric_name(f"{m}_", F.col("label")).alias("metric"), F.col(m).alias("value"))
        for m in ("precision", "recall", "f1")])
    classes = per_class_prf(cube, keys).where("support > 0").select(*keys, F.inline(rows))
    return averages.unionByName(classes)


def evaluate_macro(cube: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, metric, value): share error, share distance, and the shares and gap of every mode."""
    macro = macro_metrics(cube, keys)
    gaps = share_gaps(macro, keys)
    rows = F.array(*[
        F.struct(_metric_name(f"{m}_", F.col("mode")).alias("metric"), F.col(m).alias("value"))
        for m in ("share_gap", "true_share", "pred_share")])
    return unpivot(macro, keys, ["mode_share_mae", "mode_share_js"]).unionByName(
        gaps.select(*keys, F.inline(rows)))


def evaluate_predictions(
    df: DataFrame, keys: list[str] = [], classes: str | None = None, proba: str | None = None
) -> DataFrame:
    """Long table of the per-record metrics, with those on probabilities where there are any."""
    cube = materialize(confusion_cube(df, keys, weight=None), "cube")
    result = evaluate_micro(cube, keys)
    if proba:
        scored = probability_metrics(df, keys, classes, proba)
        result = result.unionByName(unpivot(scored, keys, ["nll", "brier_score"]))
    return result


def evaluate_all(
    predictions: DataFrame,
    keys: list[str] = ["model", "fewshot_ratio", "seed"],
    subgroups: list[str] = fv.SUBGROUP_COLUMNS,
    weight: str | None = "trip_weight",
) -> tuple[DataFrame, DataFrame]:
    """(metrics, subgroup metrics) of every run in one pass over all prediction rows.

    Invalid predictions are left out of the scores and counted as n_total - n_valid.
    """
    return evaluate_cube(materialize(confusion_cube(predictions, keys, subgroups, weight=weight), "cube"), keys, subgroups)


def evaluate_cube(cube: DataFrame, keys: list[str], subgroups: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two results of ``evaluate_all`` from a stored tally."""
    totals = cube.groupBy(*keys).agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(F.coalesce("y_pred", F.lit(-1)) >= 1, F.col("n"))), F.lit(0)).alias("n_valid"),
    )
    valid = filter_valid_predictions(cube, "y_pred")
    metrics = (
        evaluate_micro(valid, keys)
        .unionByName(evaluate_macro(valid, keys))
        .unionByName(unpivot(totals, keys, ["n_total", "n_valid"]))
    )
    return metrics, subgroup_macro(valid, subgroups, keys)


