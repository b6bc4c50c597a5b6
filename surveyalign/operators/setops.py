"""Unions, exclusions and distinct sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_years(*years: DataFrame) -> DataFrame:
    """Canonical tables of several years as one."""
    result = years[0]
    for df in years[1:]:
        result = result.unionByName(df)
    return result


def exclude_sampled(df: DataFrame, sampled: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of ``df`` that are not in the sample."""
    return df.join(sampled.select(key), key, "left_anti")


def distinct_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.select(left, right).distinct().orderBy(left, right)


def label_set_difference(df: DataFrame, column: str, allowed: list[int]) -> DataFrame:
    """Values that occur but are not allowed, with their row counts."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))
        .groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
