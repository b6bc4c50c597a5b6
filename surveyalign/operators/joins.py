"""Joins of the raw survey tables to one row per trip.

All of them are left joins that keep every trip. The right sides carry no broadcast
hint: the optimizer broadcasts a table whose size it knows to be small and otherwise
shuffles, where adaptive execution splits a household that holds too many trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.codes import car_availability
from surveyalign.operators.filters import filter_main_modes


def select_available(df: DataFrame, columns: list[str]) -> DataFrame:
    """Project the configured columns, leaving out those the table does not have."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def _left_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    renamed = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(renamed), keys, "left")


def join_trip_member(trips: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return _left_join(trips, members, keys, "_hm")


def join_household(trips: DataFrame, households: DataFrame, key: str) -> DataFrame:
    return _left_join(trips, households, [key], "_hh")


def join_zone_lookup(trips: DataFrame, lookup: DataFrame, survey: dict = fv.SURVEY_2011) -> DataFrame:
    """Add the origin and destination districts. A zone with two districts gives two rows."""
    zone, district = survey["lookup"]["zone"], survey["lookup"]["district"]
    roles = survey["trip"]
    pairs = lookup.select(F.col(f"`{zone}`"), F.col(f"`{district}`")).distinct()
    for key, target in (("origin_lookup", "origin_zone"), ("dest_lookup", "dest_zone")):
        side = pairs.withColumnsRenamed({zone: roles[key], district: roles[target]})
        trips = trips.join(side, roles[key], "left")
    return trips


def household_attributes(households: DataFrame, survey: dict) -> DataFrame:
    """Household id and attributes with the vehicle counts folded into one band."""
    roles = survey["household"]
    keep = [roles[r] for r in ("household_id", "hh_type", "hh_size", "hh_income", "hh_weight") if r in roles]
    if survey["year"] == 2011:
        keep.append(roles["zone"])
    cars = car_availability(households, roles["car_cols"], negative_is_none=survey["year"] == 2011)
    present = [F.col(f"`{c}`") for c in keep if c in households.columns]
    return households.select(*present, cars.alias("car_availability_raw"))


def member_attributes(members: DataFrame, survey: dict) -> DataFrame:
    roles = survey["member"]
    wanted = ("household_id", "member_id", "sex", "age", "employment", "member_weight", "urban_rural")
    return select_available(members, [roles[r] for r in wanted])


def trip_attributes(trips: DataFrame, survey: dict) -> DataFrame:
    roles = survey["trip"]
    wanted = [
        "household_id", "member_id", "trip_no", "trip_purpose", "main_mode", "depart_time",
        "arrive_time", "journey_time", "origin_lookup", "dest_lookup", "time_period", "trip_weight",
    ]
    if survey["year"] != 2011:
        wanted = [w for w in wanted if w != "arrive_time"] + ["origin_zone", "dest_zone"]
    return select_available(trips, [roles[r] for r in wanted if r in roles])


def _join_survey(tables: dict[str, DataFrame], survey: dict) -> DataFrame:
    household_id, member_id = survey["trip"]["household_id"], survey["trip"]["member_id"]
    trips = trip_attributes(tables["trip"], survey)
    trips = join_trip_member(trips, member_attributes(tables["member"], survey), [household_id, member_id])
    return join_household(trips, household_attributes(tables["household"], survey), household_id)


def load_joined_2011(tables: dict[str, DataFrame], survey: dict = fv.SURVEY_2011) -> DataFrame:
    """First survey: trips with member, household and district columns."""
    return join_zone_lookup(_join_survey(tables, survey), tables["lookup"], survey)


def load_joined_2022(
    tables: dict[str, DataFrame], survey: dict = fv.SURVEY_2022, max_mode: int | None = fv.MAX_RAW_MODE
) -> DataFrame:
    """Second survey: trips of the shared modes with member and household columns.

    ``max_mode=None`` keeps every raw mode.
    """
    if max_mode is not None:
        kept = filter_main_modes(tables["trip"], survey["trip"]["main_mode"], max_mode)
        tables = {**tables, "trip": kept}
    return _join_survey(tables, survey)


def attach_predictions(test: DataFrame, predictions: DataFrame, key: str = "case_id") -> DataFrame:
    """Predictions next to their test rows, matched by key and never by position.

    A test row that repeats gets its key's prediction each time; two predictions for one key
    are an error, as either could be meant.
    """
    others = [c for c in predictions.columns if c != key]
    grouped = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others)).alias("_p"))
    message = F.concat(F.lit("several predictions for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    once = grouped.select(key, F.when(F.col("_n") == 1, F.col("_p")).otherwise(F.raise_error(message).cast(grouped.schema["_p"].dataType)).alias("_p"))
    return test.join(once, key, "left").select("*", "_p.*").drop("_p")
