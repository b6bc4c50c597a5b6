"""Row filters of the canonical trip table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.codes import numeric


def valid_record() -> Column:
    """Mode, purpose and age group are known."""
    return (F.col("main_mode") >= 1) & (F.col("trip_purpose") >= 1) & (F.col("age_group") >= 1)


def plausible_journey(max_minutes: float = fv.MAX_JOURNEY_MINUTES) -> Column:
    """No journey time, or one within the limit. NaN counts as none.

    The column is named once: the optimizer puts all that it derives from into the filter.
    """
    limit = F.lit(float(max_minutes))
    return F.coalesce(F.nanvl(F.col("journey_time").cast("double"), limit) <= limit, F.lit(True))


def filter_valid_records(df: DataFrame) -> DataFrame:
    return df.where(valid_record())


def filter_main_modes(
    trips: DataFrame, mode_col: str = "Main_mode", max_mode: int = fv.MAX_RAW_MODE
) -> DataFrame:
    """Keep raw modes up to ``max_mode``: drops other, walk and unknown codes and null.

    Text columns are read as numbers; text that is no number is dropped.
    """
    return trips.where(numeric(trips, mode_col) <= max_mode)


def filter_journey_time(df: DataFrame, max_minutes: float = fv.MAX_JOURNEY_MINUTES) -> DataFrame:
    return df.where(plausible_journey(max_minutes))


def apply_all_filters(df: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Valid records within the journey limit.

    ``observation`` reports the row counts of the three stages from the same pass.
    """
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("n_input"),
            F.count_if(valid_record()).alias("n_valid"),
            F.count_if(valid_record() & plausible_journey()).alias("n_kept"),
        )
    return filter_journey_time(filter_valid_records(df))


def valid_prediction(column: str = "predicted_mode") -> Column:
    return F.coalesce(F.col(column), F.lit(-1)) >= 1


def filter_valid_predictions(df: DataFrame, column: str = "predicted_mode") -> DataFrame:
    return df.where(valid_prediction(column))


def count_predictions(df: DataFrame, keys: list[str], column: str = "predicted_mode") -> DataFrame:
    """Rows, valid and invalid predictions per run."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(valid_prediction(column)).alias("n_valid"),
        F.count_if(~valid_prediction(column)).alias("n_invalid"),
    )
