"""Tables and survey inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from surveyalign.functions import fixed_values as fv


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet or csv (with header), chosen by suffix.

    Without a schema csv columns stay text; the harmonisation converts them.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.rstrip("/").endswith(".parquet"):
        return reader.parquet(path)
    if path.rstrip("/").endswith(".csv"):
        return reader.option("header", True).csv(path)
    raise ValueError(f"unsupported format: {path}")


def read_csv_quarantined(spark: SparkSession, path: str, schema: str, quarantine: str) -> DataFrame:
    """The good rows of csv files with a header under ``schema``; the bad lines are stored at ``quarantine``.

    A bad line is kept whole as (file, reason, line). Reasons: ``quotes`` (an odd number of them),
    ``short`` or ``long`` (too few or too many fields), ``value`` (a field that its type does not
    take). Empty lines and lines equal to the header of the schema are no rows. Fields hold no
    line breaks.
    """
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    lines = lines.where((F.trim("line") != "") & (F.regexp_replace("line", '"', "") != ",".join(names)))
    parsed = lines.withColumn("row", F.from_csv("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    quoted = F.regexp_replace("line", '"[^"]*"', "")
    fields = F.length(quoted) - F.length(F.replace(quoted, F.lit(","))) + 1
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"')))) % 2 == 1
    reason = F.when(odd, "quotes").when(fields < len(names), "short").when(fields > len(names), "long").when(F.col("row._bad").isNotNull(), "value")
    judged = parsed.withColumn("reason", reason)
    judged.where("reason IS NOT NULL").select("file", "reason", "line").write.mode("append").parquet(quarantine)
    return judged.where("reason IS NULL").select(*[F.col("row")[name].alias(name) for name in names])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def read_survey_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The raw tables of one survey by role (household, member, trip, lookup).

    A missing source is an error naming the role.
    """
    tables = {}
    for role, path in paths.items():
        try:
            tables[role] = read_table(spark, path)
        except AnalysisException as error:
            raise FileNotFoundError(f"{role} table not found at {path}") from error
    return tables


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per role."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(role).alias("role"), "n_rows")
        for role, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def crosswalk_table(spark: SparkSession) -> DataFrame:
    """All code mappings as rows (field, survey_year, raw_code, code)."""
    rows = [
        (field, year, raw, code)
        for (field, year), mapping in fv.CROSSWALKS.items() for raw, code in mapping.items()
    ]
    return spark.createDataFrame(rows, "field string, survey_year int, raw_code int, code int")
