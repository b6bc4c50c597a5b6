"""Expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv

SIMILARITY_DECIMALS = 10
# Weighted similarities have more digits; rounding them no shorter leaves no ties to rounding.
SCORE_DECIMALS = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero. Rounded so that it orders the same everywhere."""
    similarity = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.round(similarity, SIMILARITY_DECIMALS)


def align_proba(
    df: DataFrame, classes: str = "classes", proba: str = "proba", output: str = "aligned",
    labels: list[int] = fv.MODES,
) -> DataFrame:
    """Add the probabilities in label order: labels the model does not know 0, rows sum to 1."""
    placed = F.array(*[
        F.coalesce(F.get(F.col(proba), F.array_position(F.col(classes), label).cast("int") - 1), F.lit(0.0))
        for label in labels])
    total = sum((F.get(F.col("_placed"), F.lit(i)) for i in range(1, len(labels))), F.get(F.col("_placed"), F.lit(0)))
    safe = F.when(F.col("_sum") == 0, F.lit(1.0)).otherwise(F.col("_sum"))
    return (
        df.withColumn("_placed", placed).withColumn("_sum", total)
        .withColumn(output, F.transform("_placed", lambda p: p / safe)).drop("_placed", "_sum")
    )


def argmax_class(classes: Column, proba: Column) -> Column:
    """The class of the highest probability, the first one on ties."""
    return F.get(classes, F.array_position(proba, F.array_max(proba)).cast("int") - 1)
