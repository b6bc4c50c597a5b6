"""Report tables over the long metrics table (model, fewshot_ratio, seed, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.codes import decode, fixed_text
from surveyalign.operators.aggregates import seed_mean_std
from surveyalign.operators.filters import filter_valid_predictions

RUN_KEYS = ["model", "fewshot_ratio", "seed"]
# Run names carry model, ratio and seed.
RUN_NAME = r"([^/=]+?)_ratio([0-9.]+?)_seed([0-9]+)"


def run_columns(name: Column) -> list[Column]:
    """Model, ratio and seed from a run name; model names may contain underscores."""
    part = lambda i: F.nullif(F.regexp_extract(name, RUN_NAME, i), F.lit(""))
    return [part(1).alias("model"), part(2).try_cast("double").alias("fewshot_ratio"),
            part(3).try_cast("int").alias("seed")]


def run_name(model: Column, ratio: Column, seed: Column) -> Column:
    return F.concat(model, F.lit("_ratio"), fixed_text(ratio, 2), F.lit("_seed"), seed.cast("string"))


def strip_model_prefix(metric: Column, model: Column) -> Column:
    prefix = F.concat(model, F.lit("_"))
    return F.when(F.startswith(metric, prefix), F.substr(metric, F.length(prefix) + 1)).otherwise(metric)


def only_value(value: Column, what: Column) -> Column:
    """The value that all rows of a group share; rows that differ are an error, never a choice."""
    return F.when(F.min(value).eqNullSafe(F.max(value)), F.max(value)).otherwise(
        F.raise_error(F.concat(F.lit("different values of one metric: "), F.coalesce(F.first(what), F.lit("")))).cast("double"))


def results_frame(loaded: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics read from files (source_file, metric, value) as one wide row per run.

    Where a run has files whose names end in ``_metrics``, only they count. Files that still
    give different values for one metric of a run raise an error.
    """
    official = F.col("source_file").endswith("_metrics")
    named = loaded.select(*run_columns(F.col("source_file")), "source_file", official.alias("official"), "metric", "value")
    stripped = named.withColumn("metric", strip_model_prefix(F.col("metric"), F.col("model")))
    has_official = stripped.groupBy(*RUN_KEYS).agg(F.max("official").alias("has_official"))
    chosen = stripped.join(has_official, RUN_KEYS).where("official = has_official")
    once = chosen.groupBy(*RUN_KEYS, "metric").agg(only_value(F.col("value"), F.col("source_file")).alias("value"))
    return once.groupBy(*RUN_KEYS).agg(*[
        F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def _averages(metrics: DataFrame, wanted: list[str]) -> DataFrame:
    """Seed averages per model, ratio and metric, every run counted once."""
    once = (
        metrics.where(F.col("metric").isin(wanted))
        .groupBy(*RUN_KEYS, "metric").agg(only_value(F.col("value"), F.col("metric")).alias("value"))
    )
    return seed_mean_std(once)


def comparison_table(
    metrics: DataFrame,
    models: list[str] = ["mnl", "boosted_trees", "retrieval"],
    ratios: list[float] = fv.FEWSHOT_RATIOS,
    wanted: list[str] = fv.REPORT_METRICS,
) -> DataFrame:
    """Mean and deviation of the wanted metrics for every model and ratio; absent runs are NaN."""
    spark = metrics.sparkSession
    grid = spark.createDataFrame(
        [(m, float(r)) for m in models for r in ratios], "model string, fewshot_ratio double")
    averages = _averages(metrics, wanted)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = averages.groupBy("model", "fewshot_ratio").agg(*[
        c for m in wanted for c in (pick(m, "mean").alias(m), pick(m, "std").alias(f"{m}_std"))])
    joined = grid.join(wide, ["model", "fewshot_ratio"], "left")
    filled = [c for m in wanted for c in (
        F.coalesce(m, F.lit(float("nan"))).alias(m), F.coalesce(f"{m}_std", F.lit(0.0)).alias(f"{m}_std"))]
    return joined.select("model", "fewshot_ratio", *filled).orderBy("model", "fewshot_ratio")


def formatted_table(metrics: DataFrame, wanted: list[str] = fv.REPORT_METRICS) -> DataFrame:
    """"0.123 ± 0.045" per metric, "-" where absent, ratio as percent, model in capitals."""
    averages = _averages(metrics, wanted)

    def text(metric: str) -> Column:
        mean = F.max(F.when(F.col("metric") == metric, F.col("mean")))
        std = F.max(F.when(F.col("metric") == metric, F.col("std")))
        shown = F.concat(fixed_text(mean, 3), F.lit(" ± "), fixed_text(std, 3))
        return F.when(mean.isNotNull() & ~F.isnan(mean), shown).otherwise(F.lit("-")).alias(metric)

    return (
        averages.groupBy("model", "fewshot_ratio").agg(*[text(m) for m in wanted])
        .orderBy("model", "fewshot_ratio")
        .select(
            F.upper("model").alias("model"),
            F.concat(fixed_text(F.col("fewshot_ratio") * 100, 0), F.lit("%")).alias("fewshot_percent"),
            *wanted)
    )


def fewshot_curve(metrics: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Mean and deviation of one metric along the ratios, ratios in percent."""
    return (
        metrics.where(F.col("metric") == metric)
        .groupBy(*RUN_KEYS).agg(F.max("value").alias("value"))
        .groupBy("model", "fewshot_ratio")
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
        .select("model", (F.col("fewshot_ratio") * 100).alias("ratio_percent"), "mean", "std")
        .orderBy("model", "ratio_percent")
    )


def share_comparison(
    predictions: DataFrame, models: list[str], ratio: float = 0.05, seed: int = 42
) -> DataFrame:
    """Per mode the true share and the share each model predicts, for one ratio and seed.

    The truth counts every row of the first model, predictions only the valid ones.
    """
    chosen = predictions.where(
        F.col("model").isin(models) & (F.col("fewshot_ratio") == ratio) & (F.col("seed") == seed))
    valid = F.coalesce(F.col("predicted_mode"), F.lit(-1)) >= 1
    counts = chosen.groupBy("model", "main_mode", "predicted_mode").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("model") == models[0]
    sums = lambda label, rows: F.array(*[
        F.coalesce(F.sum(F.when(rows & (F.col(label) == c), F.col("n"))), F.lit(0)) for c in fv.MODES])
    total = lambda rows: F.sum(F.when(rows, F.col("n")))
    series = {"ground_truth": ("main_mode", first)}
    series.update({m: ("predicted_mode", valid & (F.col("model") == m)) for m in models})
    row = counts.agg(
        *[sums(label, rows).alias(name) for name, (label, rows) in series.items()],
        *[total(rows).alias(f"{name}_n") for name, (_, rows) in series.items()])
    zipped = F.arrays_zip(F.array(*[F.lit(c) for c in fv.MODES]).alias("mode"), *[F.col(n) for n in series])
    return (
        row.select(F.inline(zipped), *[f"{n}_n" for n in series])
        .select("mode", decode(F.col("mode"), fv.MODE_LABELS).alias("mode_label"), *[
            F.coalesce(F.try_divide(F.col(n), F.col(f"{n}_n")), F.lit(0.0)).alias(f"{n}_share") for n in series])
    )
