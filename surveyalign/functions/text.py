"""Trip records as labelled structs, and structs as prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.codes import decode, fixed_text

# Placeholder in the prompt texts -> path inside the context struct.
PROMPT_FIELDS = {
    "age_group": "person.age_group",
    "sex": "person.sex",
    "employment_status": "person.employment_status",
    "income_group": "person.income_group",
    "car_availability": "household.car_availability",
    "trip_purpose": "trip.trip_purpose",
    "departure_period": "trip.departure_period",
    "journey_time": "trip.journey_time",
}


def _field(source: Column | None, name: str) -> Column:
    return F.col(name) if source is None else source[name]


def journey_text(minutes: Column) -> Column:
    whole = minutes.try_cast("bigint").cast("string")
    return F.when(minutes > 0, F.concat(whole, F.lit(" minutes"))).otherwise(F.lit("unknown"))


def context(source: Column | None = None) -> Column:
    """Nested person / household / trip struct of one canonical trip (row or struct column)."""
    f = lambda name: _field(source, name)
    return F.struct(
        f("case_id").alias("case_id"),
        f("survey_year").alias("survey_year"),
        F.struct(
            decode(f("age_group"), fv.AGE_LABELS).alias("age_group"),
            decode(f("sex"), fv.SEX_LABELS).alias("sex"),
            decode(f("employment_status"), fv.EMPLOYMENT_LABELS).alias("employment_status"),
            decode(f("income_group"), fv.INCOME_LABELS).alias("income_group"),
        ).alias("person"),
        F.struct(
            F.coalesce(f("hh_size").cast("string"), F.lit("unknown")).alias("hh_size"),
            decode(f("car_availability"), fv.CAR_LABELS).alias("car_availability"),
        ).alias("household"),
        F.struct(
            decode(f("trip_purpose"), fv.PURPOSE_LABELS).alias("trip_purpose"),
            decode(f("departure_period"), fv.PERIOD_LABELS).alias("departure_period"),
            journey_text(f("journey_time")).alias("journey_time"),
            F.coalesce(f("origin_zone"), F.lit("")).alias("origin_zone"),
            F.coalesce(f("destination_zone"), F.lit("")).alias("destination_zone"),
        ).alias("trip"),
    )


def demonstration(source: Column | None = None) -> Column:
    """Context plus the label of the trip; a missing label is -1 / "Unknown"."""
    mode = _field(source, "main_mode")
    ctx = context(source)
    return F.struct(
        *[ctx[part].alias(part) for part in ("case_id", "survey_year", "person", "household", "trip")],
        F.struct(
            F.coalesce(mode, F.lit(-1)).alias("main_mode"),
            decode(mode, fv.MODE_LABELS).alias("main_mode_label"),
        ).alias("label"),
    )


def example_text(example: Column, with_label: bool = True) -> Column:
    person, household, trip = example["person"], example["household"], example["trip"]
    values = {
        "age_group": person["age_group"], "sex": person["sex"], "employment_status": person["employment_status"],
        "car_availability": household["car_availability"], "trip_purpose": trip["trip_purpose"],
        "departure_period": trip["departure_period"], "journey_time": trip["journey_time"],
        "mode": example["label"]["main_mode_label"],
    }
    return fill(fv.EXAMPLE_TEXT + (fv.EXAMPLE_LABEL_TEXT if with_label else ""), values)


def examples_text(examples: Column, max_examples: int = 4, with_label: bool = True) -> Column:
    """The first ``max_examples`` demonstrations as numbered text, a fixed text for no example."""
    numbered = F.transform(
        F.slice(examples, 1, max_examples),
        lambda ex, i: F.concat(
            F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), example_text(ex, with_label)
        ),
    )
    text = F.array_join(numbered, "\n")
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, text).otherwise(F.lit(fv.NO_EXAMPLES_TEXT))


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with every ``{name}`` replaced by its column."""
    parts, rest = [], template
    while rest:
        starts = [(rest.find("{" + name + "}"), name) for name in values]
        starts = [s for s in starts if s[0] >= 0]
        if not starts:
            parts.append(F.lit(rest))
            break
        at, name = min(starts)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)


def _context_values(ctx: Column) -> dict[str, Column]:
    values = {}
    for name, path in PROMPT_FIELDS.items():
        part, leaf = path.split(".")
        values[name] = ctx[part][leaf]
    return values


def _messages(system: str, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def evidence_messages(
    ctx: Column,
    summary: Column,
    historical: Column,
    update: Column,
    max_historical: int = 3,
    max_update: int = 4,
) -> Column:
    """System and user message with retrieved evidence; an empty summary is "(not available)"."""
    values = _context_values(ctx)
    values["prototype_summary"] = F.when(
        F.coalesce(F.length(summary), F.lit(0)) > 0, summary
    ).otherwise(F.lit("(not available)"))
    values["historical_examples"] = examples_text(historical, max_historical)
    values["update_examples"] = examples_text(update, max_update)
    return _messages(fv.EVIDENCE_SYSTEM_PROMPT, fill(fv.EVIDENCE_USER_PROMPT, values))


def profile_messages(ctx: Column) -> Column:
    """System and user message from the traveller's profile alone."""
    return _messages(fv.PROFILE_SYSTEM_PROMPT, fill(fv.PROFILE_USER_PROMPT, _context_values(ctx)))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent_text(share: Column) -> Column:
    return F.concat(fixed_text(share * 100, 1), F.lit("%"))


def prototype_label(age: Column, employment: Column, car: Column) -> Column:
    """Label from mean codes, rounded half-even."""
    band = lambda mean, labels, default: decode(F.rint(mean).cast("int"), labels, default)
    return F.concat(
        band(age, fv.AGE_LABELS, "Middle-aged"), F.lit(" "),
        band(employment, fv.EMPLOYMENT_LABELS, "Employed"), F.lit(" ("),
        band(car, fv.CAR_LABELS, "No car"), F.lit(")"),
    )


def prototype_summary(prototype_id: Column, label: Column, n: Column, mode_share: Column) -> Column:
    """Three lines: id and label, size, the mode shares above zero."""
    shares = F.array_compact(F.array(*[
        F.when(mode_share[code] > 0, F.concat(F.lit(f"{name}="), percent_text(mode_share[code])))
        for code, name in fv.MODE_LABELS.items()
    ]))
    return fill(fv.PROTOTYPE_SUMMARY_TEXT, {
        "prototype_id": prototype_id.cast("string"), "label": label, "n": thousands(n), "shares": F.array_join(shares, ", ")})
