"""Joined raw rows to the canonical trip schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.codes import (
    age_group, as_id, departure_period, hhmm_to_decimal, integer_or, journey_minutes,
    map_codes, number_or, numeric,
)


def conform_schema(df: DataFrame, schema=fv.CANONICAL_SCHEMA) -> DataFrame:
    """The canonical columns in order; absent ones become null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def key_columns(df: DataFrame, survey: dict) -> dict[str, Column]:
    """Household, person and case identifiers of a joined survey table."""
    roles = survey["trip"]
    household, member = as_id(df, roles["household_id"]), as_id(df, roles["member_id"])
    trip_no = integer_or(numeric(df, roles["trip_no"]), 0)
    year = F.lit(survey["year"])
    return {
        "case_id": F.concat_ws("_", year.cast("string"), household, member, trip_no.cast("string")),
        "household_id": household,
        "person_id": F.concat_ws("_", household, member),
        "trip_no": trip_no,
        "survey_year": year,
    }


def journey_or_elapsed(df: DataFrame, journey: str, depart: str, arrive: str) -> Column:
    """The journey column; the elapsed time instead where that column is null in every row.

    The check uses a duplicate-insensitive aggregate, so the optimizer drops the left
    joins below it and it costs a scan of one column.
    """
    value = numeric(df, journey).cast("double")
    if depart not in df.columns or arrive not in df.columns:
        return value
    any_value = df.agg(F.bool_or(value.isNotNull()).alias("any_value")).scalar()
    elapsed = journey_minutes(numeric(df, depart), numeric(df, arrive))
    return F.when(F.coalesce(any_value, F.lit(False)), value).otherwise(elapsed)


def _zone(df: DataFrame, name: str, absent: str) -> Column:
    if name not in df.columns:
        return F.lit(absent)
    return integer_or(numeric(df, name), 0, "bigint").cast("string")


def _raw_text(value: Column) -> Column:
    return integer_or(value, -1, "bigint").cast("string")


def period_or_derived(df: DataFrame, survey: dict, hhmm: bool) -> Column:
    """The official period column where the survey has one, else derived from the departure."""
    roles, year = survey["trip"], survey["year"]
    if roles["time_period"] in df.columns:
        return map_codes(numeric(df, roles["time_period"]), fv.CROSSWALKS["departure_period", year])
    depart = numeric(df, roles["depart_time"])
    return departure_period(hhmm_to_decimal(depart) if hhmm else depart)


def _common_columns(df: DataFrame, survey: dict) -> dict[str, Column]:
    year = survey["year"]
    household, member, trip = survey["household"], survey["member"], survey["trip"]
    size = household["hh_size"]
    has_cars = "car_availability_raw" in df.columns
    return {
        **key_columns(df, survey),
        "hh_size": integer_or(numeric(df, size), -1) if size in df.columns else F.lit(-1),
        "car_availability": integer_or(F.col("car_availability_raw"), 0) if has_cars else F.lit(0),
        "age_group": age_group(numeric(df, member["age"])),
        "sex": map_codes(numeric(df, member["sex"]), fv.CROSSWALKS["sex", year]),
        "employment_status": map_codes(
            numeric(df, member["employment"]), fv.CROSSWALKS["employment_status", year], 7),
        "trip_purpose": map_codes(
            numeric(df, trip["trip_purpose"]), fv.CROSSWALKS["trip_purpose", year], 7),
        "main_mode": map_codes(numeric(df, trip["main_mode"]), fv.CROSSWALKS["main_mode", year]),
        "trip_weight": number_or(numeric(df, trip["trip_weight"]), 1.0),
    }


def _select(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return conform_schema(df.select(*[c.alias(name) for name, c in columns.items()]))


def harmonize_2011(df: DataFrame, survey: dict = fv.SURVEY_2011) -> DataFrame:
    """First survey in canonical form; keeps the raw mode and purpose as text."""
    trip = survey["trip"]
    columns = _common_columns(df, survey)
    columns["income_group"] = map_codes(
        numeric(df, survey["household"]["hh_income"]), fv.CROSSWALKS["income_group", 2011], 0)
    columns["departure_period"] = period_or_derived(df, survey, hhmm=True)
    columns["journey_time"] = journey_or_elapsed(
        df, trip["journey_time"], trip["depart_time"], trip["arrive_time"])
    columns["origin_zone"] = _zone(df, trip["origin_zone"], "0")
    columns["destination_zone"] = _zone(df, trip["dest_zone"], "0")
    columns["raw_mode_2011"] = _raw_text(numeric(df, trip["main_mode"]))
    columns["raw_purpose_2011"] = _raw_text(numeric(df, trip["trip_purpose"]))
    return _select(df, columns)


def harmonize_2022(df: DataFrame, survey: dict = fv.SURVEY_2022) -> DataFrame:
    """Second survey in canonical form; it has no income and no raw columns."""
    trip = survey["trip"]
    columns = _common_columns(df, survey)
    columns["income_group"] = F.lit(0)
    columns["departure_period"] = period_or_derived(df, survey, hhmm=False)
    columns["journey_time"] = numeric(df, trip["journey_time"]).cast("double")
    columns["origin_zone"] = _zone(df, trip["origin_zone"], "")
    columns["destination_zone"] = _zone(df, trip["dest_zone"], "")
    return _select(df, columns)
