"""Raw survey tables to the cleaned canonical table of both years."""

from __future__ import annotations

from pyspark.sql import DataFrame

from surveyalign.operators.filters import apply_all_filters
from surveyalign.operators.harmonize import harmonize_2011, harmonize_2022
from surveyalign.operators.joins import load_joined_2011, load_joined_2022
from surveyalign.operators.setops import union_years


def preprocess_2011(tables: dict[str, DataFrame]) -> DataFrame:
    return apply_all_filters(harmonize_2011(load_joined_2011(tables)))


def preprocess_2022(tables: dict[str, DataFrame]) -> DataFrame:
    """The raw mode filter comes before the joins."""
    return apply_all_filters(harmonize_2022(load_joined_2022(tables)))


def harmonized_dataset(tables_2011: dict[str, DataFrame], tables_2022: dict[str, DataFrame]) -> DataFrame:
    return union_years(preprocess_2011(tables_2011), preprocess_2022(tables_2022))
