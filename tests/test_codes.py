import datetime
import math

import pytest
from pyspark.sql import functions as F

from surveyalign.functions import codes as C
from surveyalign.functions import fixed_values as fv


def column(spark, values, dtype, expression):
    """Values of an expression over a one-column frame ``x``."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expression(df)).collect()]


def test_age_edges(spark):
    ages = [0, 14, 15, 24, 25, 44, 45, 64, 65, 119, 120, -1, None]
    assert column(spark, ages, "int", lambda df: C.age_group(F.col("x"))) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, -1, -1, -1]


def test_fractional_and_missing_ages(spark):
    ages = [14.9, 119.5, float("nan"), None]
    assert column(spark, ages, "double", lambda df: C.age_group(C.numeric(df, "x"))) == [1, 5, -1, -1]


def test_hhmm(spark):
    assert column(spark, [830, 1530, None], "int", lambda df: C.hhmm_to_decimal(F.col("x"))) == [8.5, 15.5, -1.0]


def test_journey_wraps_midnight(spark):
    df = spark.createDataFrame([(2330, 15), (830, 900), (None, 900), (830, None)], "d int, a int")
    minutes = [r[0] for r in df.select(C.journey_minutes(F.col("d"), F.col("a"))).collect()]
    assert minutes[0] == pytest.approx(45.0) and minutes[1] == pytest.approx(30.0)
    assert minutes[2:] == [None, None]


def test_period_edges(spark):
    hours = [6.99, 7.0, 9.5, 16.5, 19.0, None]
    assert column(spark, hours, "double", lambda df: C.departure_period(F.col("x"))) == [4, 1, 2, 3, 4, -1]


def test_missing_hhmm_counts_as_off_peak(spark):
    assert column(spark, [None], "int", lambda df: C.departure_period(C.hhmm_to_decimal(F.col("x")))) == [4]


def test_id_text(spark):
    assert column(spark, ["12", "12.9", "abc", None, "12d", " 7 "], "string", lambda df: C.as_id(df, "x")) == [
        "12", "12", "-1", "-1", "-1", "7"]
    assert column(spark, [12.0, 12.9, None], "double", lambda df: C.as_id(df, "x")) == ["12", "12", "-1"]


def test_long_ids_keep_their_digits(spark):
    assert column(spark, ["9007199254740993"], "string", lambda df: C.as_id(df, "x")) == ["9007199254740993"]


def test_map_codes_by_type(spark):
    mapping = fv.CROSSWALKS["trip_purpose", 2011]
    for values, dtype in (([1.0, 1.5, 4.0, 6.0, None], "double"), (["1", "1.5", "4", "x", None], "string")):
        assert column(spark, values, dtype, lambda df: C.map_codes(C.numeric(df, "x"), mapping, 7)) == [1, 7, 1, 7, 7]


def test_car_bands(spark):
    df = spark.createDataFrame(
        [(0, None, None), (1, 1.0, None), (2, 1.0, 1.0), (3, 0.5, None), (4, -1.0, 0.0)], "i int, a double, b double").orderBy("i")
    bands = lambda flag: [r[0] for r in df.select(C.car_availability(df, ["a", "b", "gone"], flag)).collect()]
    assert bands(True) == [0, 1, 2, 2, 0]
    assert bands(False) == [0, 1, 2, 2, 2]
    assert df.select(C.car_availability(df, ["gone"], True)).first()[0] == 0


def test_zone_int(spark):
    assert column(spark, ["12", "", "x", None, "7.9"], "string", lambda df: C.zone_int(F.col("x"))) == [12, 0, 0, 0, 7]


def test_decode_unknown(spark):
    assert column(spark, [1, 9, 10, None], "int", lambda df: C.decode(F.col("x"), fv.MODE_LABELS)) == [
        "Rail", "SPB", "Unknown", "Unknown"]


def test_fixed_text_rounds_as_printf(spark):
    import random

    rng = random.Random(7)
    values = [12.25, 12.35, 0.1235, 2.5, 0.0005, 0.05, 99.95, 100.0, 0.0] + [rng.random() * 100 for _ in range(500)]
    values += [n / 2000 for n in range(0, 400, 3)] + [n / 8 for n in range(80)]
    for digits in (0, 1, 3):
        got = column(spark, values, "double", lambda df: C.fixed_text(F.col("x"), digits))
        assert got == [f"{v:.{digits}f}" for v in values]
