"""Free-text model responses to (mode, confidence, reasoning), without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv

# Accepted keys in order of precedence, and the patterns.
MODE_KEYS = ["predicted_mode", "mode", "main_mode"]
FALLBACK_MODE_KEYS = ["mode_code", "transport_mode", "predicted"]
CONFIDENCE_KEYS = ["confidence", "probability"]
REASONING_KEYS = ["reasoning_brief", "reasoning", "reason"]
FLAT_OBJECT = r"\{[^{}]*\}"
MODE_DIGIT = r"\b([1-9])\b"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
FLOAT_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"
# A key with a scalar value that comes again later in the text, and number names that JSON lacks.
EARLIER_KEY = r'(?s)("(?:[^"\\]|\\.)*")\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^,{}\[\]"]+)\s*,(?=.*\1\s*:)'
NUMBER_NAMES = {"NaN": "nan", "-Infinity": "-inf", "Infinity": "inf"}
MAX_REASONING = 500

_OBJECT = "map<string,variant>"


def _json_items(text: Column) -> Column:
    """The JSON values of the text. The brackets make trailing text an error."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")


def _only(items: Column) -> Column:
    """The item of a list of one, null otherwise; ``items`` is written, and evaluated, once."""
    single = F.filter(F.array(items), lambda list_: F.size(list_) == 1)
    return F.get(F.get(single, F.lit(0)), F.lit(0))


def _repaired(text: Column) -> Column:
    """The text with the last of repeated keys and with named numbers as text."""
    repaired = F.regexp_replace(text, EARLIER_KEY, "")
    for name, value in NUMBER_NAMES.items():
        repaired = F.regexp_replace(repaired, rf"([:\[,]\s*){name}(?=\s*[,}}\]])", f'$1"{value}"')
    return repaired


def _lenient(text: Column) -> Column:
    """The text as one JSON value; where it is none, the repaired text."""
    return F.coalesce(_only(_json_items(text)), _only(_json_items(_repaired(text))))


def _first_present(data: Column, keys: list[str]) -> Column:
    """The first of the keys that the object has, null without any; a JSON null is present."""
    return F.get(F.filter(F.array(*[F.lit(k) for k in keys]), lambda key: F.map_contains_key(data, key)), F.lit(0))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _as_int(kind: Column, text: Column) -> Column:
    """Integer of a JSON number (truncated), boolean or integer text; null for anything else."""
    return (
        F.when(_is_number(kind), text.try_cast("double").try_cast("bigint"))
        .when(kind == "BOOLEAN", (text == "true").cast("bigint"))
        .when((kind == "STRING") & text.rlike(INTEGER_TEXT), F.trim(text).try_cast("bigint"))
    )


def _as_float(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "BOOLEAN", (text == "true").cast("double"))
        .when(_is_number(kind) | ((kind == "STRING") & text.rlike(FLOAT_TEXT)), text.try_cast("double"))
    )


def _as_text(value: Column, kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(text.isNotNull(), text)
        .otherwise(F.to_json(value))
    )


def _python_type(kind: Column) -> Column:
    return (
        F.when(kind.startswith("ARRAY"), "list").when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool").when(kind == "VOID", "NoneType")
        .when(kind == "BIGINT", "int").otherwise("float")
    )


def parse_responses(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Add predicted_mode, confidence and reasoning_brief parsed from the response text.

    The whole text, else its first flat ``{...}`` block, is read as JSON. The mode comes
    from the first present mode key; text is searched for a digit 1..9; what is still
    no mode falls back to the alternative keys, which only such rows look at, and then to mode 1.
    The steps are separate columns so that each is evaluated once per row.
    """
    text = F.col(raw)
    block = F.nullif(F.regexp_extract(text, FLAT_OBJECT, 0), F.lit(""))
    steps = df.withColumn("_items", _json_items(text))
    steps = steps.withColumn("_whole", F.coalesce(_only(F.col("_items")), _only(_json_items(_repaired(text)))))
    steps = steps.withColumn(
        "_value", F.when(F.col("_whole").isNotNull(), F.col("_whole")).otherwise(_lenient(block)))
    steps = steps.withColumns({
        "_kind": F.schema_of_variant("_value"),
        "_data": F.try_variant_get("_value", "$", _OBJECT),
    })
    data = F.col("_data")
    # Arrays of keys rather than a branch per key, values and their kinds as columns of their own: all of
    # it in one expression is a method larger than the JVM compiles.
    asked = {"mode": MODE_KEYS, "confidence": CONFIDENCE_KEYS, "reason": REASONING_KEYS}
    steps = steps.withColumns({f"_{name}_key": _first_present(data, keys) for name, keys in asked.items()})
    steps = steps.withColumns({f"_{name}_value": data[F.col(f"_{name}_key")] for name in asked})
    steps = steps.withColumns({f"_{name}_{part}": take(F.col(f"_{name}_value")) for name in asked for part, take in (("kind", _kind), ("text", _text))})
    told = lambda name: (F.col(f"_{name}_kind"), F.col(f"_{name}_text"))
    searched = F.regexp_extract(_as_text(F.col("_mode_value"), *told("mode")), MODE_DIGIT, 1).try_cast("bigint")
    steps = steps.withColumns({
        "_mode": F.when(F.col("_mode_key").isNotNull(), F.coalesce(_as_int(*told("mode")), searched)),
        "_confidence": F.coalesce(_as_float(*told("confidence")), F.lit(0.5)),
        "_reason": F.when(F.col("_reason_key").isNotNull(), F.substring(_as_text(F.col("_reason_value"), *told("reason")), 1, MAX_REASONING)),
        "_failure": F.when(~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)), "empty_response")
        .when(F.col("_value").isNull(), "json_decode_error")
        .when(data.isNull(), F.concat(
            F.lit("error: '"), _python_type(F.col("_kind")), F.lit("' object has no attribute 'get'"))),
    })
    failed = F.col("_failure").isNotNull()
    known = F.filter(F.transform(F.array(*[data[k] for k in FALLBACK_MODE_KEYS]), lambda v: _as_int(_kind(v), _text(v))), lambda code: code.isNotNull())
    fallback = F.coalesce(F.get(known, F.lit(0)), F.lit(1))
    mode = F.when(F.col("_mode").isin(fv.MODES), F.col("_mode")).otherwise(fallback)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_confidence")))
    return steps.select(
        *df.columns,
        F.when(failed, -1).otherwise(mode).cast("int").alias("predicted_mode"),
        F.when(failed, 0.0).otherwise(clamped).alias("confidence"),
        F.coalesce("_failure", "_reason", F.lit("")).alias("reasoning_brief"),
    )
