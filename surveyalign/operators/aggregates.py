"""Distributions and summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.operators.medians import exact_medians
from surveyalign.functions.codes import decode


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every value, null included, in value order."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total).orderBy("value")


def label_counts(df: DataFrame, column: str = fv.TARGET_COLUMN) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy("label")
    )


def category_ranges(df: DataFrame, columns: list[str] = fv.CATEGORICAL_COLUMNS) -> DataFrame:
    """Distinct non-null values of each column as rows (column_name, value), in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("value"))
        for c in columns if c in df.columns
    ])
    return (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull())
        .distinct().orderBy("column_name", "value")
    )


def profile_column(df: DataFrame, column: str, key: str) -> DataFrame:
    """Type, rows, nulls and distinct values of a column, and its value in the 20 first rows by key."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    head = df.select(key, column).orderBy(key).limit(20).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct(F.col(key), F.col(column).cast("string").alias("v")))),
                lambda s: F.coalesce(s["v"], F.lit("null")),
            ), ",")
    ).scalar()
    return counts.agg(
        F.lit(df.schema[column].dataType.simpleString()).alias("dtype"),
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(column).alias("n_distinct"),
        F.min(column).alias("min_value"),
        F.max(column).alias("max_value"),
    ).withColumn("head_20", head)


def column_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n): the distinct values of a column in order, null first, with their rows."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("value").asc_nulls_first())


def share_columns(label: Column, weight: Column, codes: list[int]) -> list[Column]:
    """Weight per listed code, and in total, as aggregate expressions."""
    per_code = [F.sum(F.when(label == c, weight).otherwise(0.0)) for c in codes]
    return [F.array(*per_code).alias("weights"), F.sum(weight).alias("total")]


def mode_shares(
    df: DataFrame, label: str = fv.TARGET_COLUMN, weight: str | None = None, codes: list[int] = fv.MODES
) -> DataFrame:
    """Share of every listed code, absent ones 0; the total includes unlisted codes.

    A total of zero gives zero shares. One aggregate row, spread over the code list.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums = df.agg(*share_columns(F.col(label), w, codes))
    return (
        sums.select("total", F.posexplode("weights").alias("pos", "weight"))
        .select(
            F.get(F.array(*[F.lit(c) for c in codes]), F.col("pos")).alias("mode"),
            F.when(F.coalesce(F.col("total"), F.lit(0.0)) == 0, 0.0)
            .otherwise(F.try_divide("weight", "total")).alias("share"),
        )
    )


def cross_year_shares(df: DataFrame, years: tuple[int, int] = (2011, 2022)) -> DataFrame:
    """Unweighted share of every occurring mode in each year, side by side."""
    counts = df.groupBy("main_mode").agg(*[
        F.count_if(F.col("survey_year") == y).alias(f"n_{y}") for y in years
    ])
    shares = [
        F.try_divide(F.col(f"n_{y}"), counts.agg(F.sum(f"n_{y}")).scalar()).alias(f"share_{y}")
        for y in years
    ]
    label = decode(F.col("main_mode"), fv.MODE_LABELS).alias("mode_label")
    return counts.select("main_mode", label, *shares).orderBy("main_mode")


def year_mode_distribution(df: DataFrame) -> DataFrame:
    """Counts and percentages per year, of the modes and of the purposes."""
    counts = df.groupBy("survey_year", "main_mode", "trip_purpose").agg(F.count(F.lit(1)).alias("n"))
    fields = F.array(
        F.struct(F.lit("main_mode").alias("field"), F.col("main_mode").alias("code")),
        F.struct(F.lit("trip_purpose").alias("field"), F.col("trip_purpose").alias("code")),
    )
    tall = (
        counts.select("survey_year", "n", F.inline(fields))
        .groupBy("survey_year", "field", "code").agg(F.sum("n").alias("n"))
    )
    # At most a few dozen aggregated rows per window.
    total = F.sum("n").over(Window.partitionBy("survey_year", "field"))
    label = F.when(F.col("field") == "main_mode", decode(F.col("code"), fv.MODE_LABELS)).otherwise(
        decode(F.col("code"), fv.PURPOSE_LABELS))
    return tall.select("survey_year", "field", "code", label.alias("label"), "n",
                       (F.col("n") / total * 100).alias("percent"))


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median, mean and population deviation of each column; NaN counts as missing.

    The medians come from a few histogram passes, the rest from one aggregate.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    medians = exact_medians(df, value)
    stats = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(medians[c]).cast("double").alias("median"),
            F.avg(value[c]).alias("mean"),
            F.stddev_pop(value[c]).alias("std"),
        ) for c in columns
    ]).alias("stats"))
    return stats.select(F.inline("stats"))


def seed_mean_std(
    metrics: DataFrame, keys: list[str] = ["model", "fewshot_ratio", "metric"], value: str = "value"
) -> DataFrame:
    """Mean and sample deviation over the seeds; one seed has deviation 0, none has mean NaN."""
    return metrics.groupBy(*keys).agg(
        F.coalesce(F.avg(value), F.lit(float("nan"))).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.count(value).alias("n_seeds"),
    )
