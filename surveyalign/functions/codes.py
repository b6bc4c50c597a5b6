"""Column expressions that turn raw survey codes into canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(df: DataFrame, name: str) -> Column:
    """The column as a number: unparsable text and NaN become null, integers stay integers."""
    col = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        return col
    if isinstance(dtype, T.BooleanType):
        return col.cast("int")
    if isinstance(dtype, T.StringType):
        # Java's parser takes a trailing type letter ("12d"), which is no survey number.
        value = F.when(~col.rlike(r"[dDfF]\s*$"), col.try_cast("double"))
    else:
        value = col.cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def integer_or(value: Column, default: int, dtype: str = "int") -> Column:
    """Truncate to an integer, ``default`` where null or out of range."""
    return F.coalesce(value.try_cast(dtype), F.lit(default).cast(dtype))


def number_or(value: Column, default: float) -> Column:
    return F.coalesce(value.cast("double"), F.lit(default))


def map_codes(value: Column, mapping: dict[int, int], default: int = -1) -> Column:
    """Crosswalk lookup; unknown and null codes give ``default``, 1.0 matches 1 and 1.5 nothing."""
    # A literal map is looked up once per row; a branch per code would repeat ``value``, and all of it
    # again in every filter that the optimizer moves below the mapping.
    pairs = [F.lit(x) for raw, code in mapping.items() for x in (float(raw), code)]
    return F.coalesce(F.create_map(*pairs)[value.cast("double")], F.lit(default)) if pairs else F.lit(default)


def as_id(df: DataFrame, name: str) -> Column:
    """Identifier as integer text, "-1" where it is no number."""
    whole = numeric(df, name).try_cast("bigint")
    if isinstance(df.schema[name].dataType, T.StringType):
        # Keep the digits of long ids that a double cannot hold.
        whole = F.coalesce(F.col(f"`{name}`").try_cast("bigint"), whole)
    return F.coalesce(whole, F.lit(-1).cast("bigint")).cast("string")


def age_group(age: Column) -> Column:
    """Age in years to bands 1..5; null, negative and 120 or more give -1."""
    return (
        F.when(age.isNull() | (age < 0) | (age >= 120), -1)
        .when(age < 15, 1).when(age < 25, 2).when(age < 45, 3).when(age < 65, 4)
        .otherwise(5)
    )


def hhmm_to_decimal(hhmm: Column) -> Column:
    """830 -> 8.5; a missing time gives -1.0."""
    hours = F.floor(hhmm / 100).cast("double")
    minutes = F.pmod(hhmm.cast("double"), F.lit(100.0))
    return F.coalesce(hours + minutes / 60.0, F.lit(-1.0))


def journey_minutes(depart_hhmm: Column, arrive_hhmm: Column) -> Column:
    """Minutes from departure to arrival, over midnight where negative; null if either is missing."""
    minutes = (hhmm_to_decimal(arrive_hhmm) - hhmm_to_decimal(depart_hhmm)) * 60
    wrapped = F.when(minutes >= 0, minutes).otherwise(minutes + 1440)
    return F.when(depart_hhmm.isNotNull() & arrive_hhmm.isNotNull(), wrapped)


def departure_period(decimal_hour: Column) -> Column:
    """Decimal hour to AM peak, inter-peak, PM peak or off-peak; null gives -1."""
    return (
        F.when(decimal_hour.isNull(), -1)
        .when((decimal_hour >= 7) & (decimal_hour < 9.5), 1)
        .when((decimal_hour >= 9.5) & (decimal_hour < 16.5), 2)
        .when((decimal_hour >= 16.5) & (decimal_hour < 19), 3)
        .otherwise(4)
    )


def car_availability(df: DataFrame, columns: list[str], negative_is_none: bool) -> Column:
    """Band 0 / 1 / 2+ of the summed vehicle counts; no such column gives 0.

    A negative sum counts as no car in the first survey and as 2+ in the second.
    """
    present = [numeric(df, c) for c in columns if c in df.columns]
    if not present:
        return F.lit(0)
    total = sum((F.coalesce(c, F.lit(0)) for c in present[1:]), F.coalesce(present[0], F.lit(0)))
    none = total <= 0 if negative_is_none else total == 0
    return F.when(none, 0).when(total == 1, 1).otherwise(2)


def decode(code: Column, labels: dict[int, str], default: str = "Unknown") -> Column:
    """Code to label; ``default`` for unknown codes and null."""
    entries = ", ".join(f"{key}, '{label}'" for key, label in labels.items())
    return F.coalesce(F.element_at(F.expr(f"map({entries})"), code.cast("int")), F.lit(default))


def zone_int(zone: Column) -> Column:
    """Zone text to integer, 0 where it is no number."""
    number = zone.try_cast("double")
    return integer_or(F.when(~F.isnan(number), number), 0)


def round_half_even(value: Column, digits: int) -> Column:
    """``round(value * 10**digits)`` as bigint, correctly rounded with ties to even.

    Decimal text in the reports must not depend on how an engine breaks ties, so the
    product is carried with its exact rounding error (Dekker's product) and the tie is
    decided on the exact value.
    """
    value = value.cast("double")
    scale = float(10 ** digits)
    splitter = F.lit(134217729.0)  # 2**27 + 1
    high = splitter * value - (splitter * value - value)
    low = value - high
    product = value * F.lit(scale)
    # The scale has at most 27 significant bits, so it needs no splitting itself.
    error = (high * scale - product) + low * scale
    floor = F.floor(product)
    gap = (product - floor) - F.lit(0.5)
    up = (gap > 0) | ((gap == 0) & (error > 0)) | ((gap == 0) & (error == 0) & (floor % 2 == 1))
    return floor + up.cast("bigint")


def fixed_text(value: Column, digits: int) -> Column:
    """``value`` with exactly ``digits`` decimals as text."""
    whole = round_half_even(F.abs(value), digits)
    base = 10 ** digits
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.floor(whole / base).cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((whole % base).cast("string"), digits, "0"))
    return F.concat(sign, text)
