"""Feature vectors of canonical trips."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.codes import zone_int
from surveyalign.operators.medians import exact_medians

# Integer features that come from the zone text where the table has no such column.
ZONE_SOURCES = {"origin_zone_int": "origin_zone", "dest_zone_int": "destination_zone"}


def raw_feature(df: DataFrame, name: str, zero_unknown: bool = True) -> Column | None:
    """The feature before imputation, None where the table cannot provide it.

    With ``zero_unknown`` the unknown categories, null or negative, share the code 0.
    """
    if name in df.columns:
        value = F.col(name).cast("double")
        value = F.when(~F.isnan(value), value)
    elif ZONE_SOURCES.get(name) in df.columns:
        value = zone_int(F.col(ZONE_SOURCES[name])).cast("double")
    else:
        return None
    if zero_unknown and name in fv.CATEGORICAL_COLUMNS:
        return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    return value


@dataclass
class TabularEncoder:
    """Imputation medians and population mean and deviation, fitted on one table."""

    features: list[str]
    medians: list[float]
    means: list[float]
    deviations: list[float]
    zero_unknown: bool = True

    @classmethod
    def fit(
        cls, df: DataFrame, features: list[str] = fv.RETRIEVAL_FEATURES, zero_unknown: bool = True
    ) -> "TabularEncoder":
        """One aggregate for counts and means, and a few histogram passes for exact medians.

        Mean and deviation are those of the imputed column: the nulls enter as copies of
        the median, which shifts both in closed form.
        """
        present = {name: raw_feature(df, name, zero_unknown) for name in features}
        present = {name: col for name, col in present.items() if col is not None}
        stats = df.agg(F.count(F.lit(1)).alias("_rows"), *[
            F.struct(
                F.count(col).alias("n"),
                F.avg(col).alias("mean"), F.var_pop(col).alias("variance"),
            ).alias(name) for name, col in present.items()
        ]).first()
        rows = stats["_rows"]
        middle = exact_medians(df, present)
        medians, means, deviations = [], [], []
        for name in features:
            if name not in present or not rows or not stats[name]["n"]:
                medians.append(0.0), means.append(0.0), deviations.append(0.0)
                continue
            s, median = stats[name], middle[name]
            known, missing = s["n"] / rows, 1 - s["n"] / rows
            variance = known * s["variance"] + known * missing * (s["mean"] - median) ** 2
            medians.append(median)
            means.append(known * s["mean"] + missing * median)
            deviations.append(variance ** 0.5)
        return cls(list(features), medians, means, deviations, zero_unknown)

    def imputed(self, df: DataFrame) -> list[Column]:
        """Feature columns with medians for nulls; a feature the table lacks is 0."""
        columns = []
        for name, median in zip(self.features, self.medians):
            value = raw_feature(df, name, self.zero_unknown)
            columns.append(F.lit(0.0) if value is None else F.coalesce(value, F.lit(median)))
        return columns

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the scaled vector; a constant feature is only centred."""
        scaled = [
            (value - F.lit(mean)) / F.lit(deviation if deviation else 1.0)
            for value, mean, deviation in zip(self.imputed(df), self.means, self.deviations)
        ]
        return df.withColumn(output, F.array(*scaled))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, *row, self.zero_unknown)
            for i, row in enumerate(zip(self.features, self.medians, self.means, self.deviations))
        ]
        return spark.createDataFrame(
            rows, "position int, feature string, median double, mean double, std double, zero_unknown boolean")

    @classmethod
    def from_frame(cls, params: DataFrame) -> "TabularEncoder":
        rows = sorted(params.collect(), key=lambda r: r["position"])  # one row per feature
        return cls([r["feature"] for r in rows], [r["median"] for r in rows],
                   [r["mean"] for r in rows], [r["std"] for r in rows], rows[0]["zero_unknown"])


def encode_for_retrieval(
    df: DataFrame, encoder: TabularEncoder | None = None, features: list[str] = fv.RETRIEVAL_FEATURES
) -> tuple[DataFrame, TabularEncoder]:
    encoder = encoder or TabularEncoder.fit(df, features)
    return encoder.transform(df), encoder


def encode_for_model(
    df: DataFrame, encoder: TabularEncoder | None = None, features: list[str] = fv.MODEL_FEATURES
) -> tuple[DataFrame, TabularEncoder]:
    encoder = encoder or TabularEncoder.fit(df, features)
    return encoder.transform(df), encoder


class OrdinalEncoder:
    """Position of each code among the codes seen in fitting, in text order; unseen codes give 0."""

    def __init__(self, columns: list[str] = fv.CATEGORICAL_COLUMNS):
        self.columns = columns

    def _text(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            f"_{c}_text": F.coalesce(F.col(c).try_cast("int"), F.lit(-1)).cast("string")
            for c in self.columns if c in df.columns
        })

    def fit(self, df: DataFrame) -> "OrdinalEncoder":
        self.columns = [c for c in self.columns if c in df.columns]
        self.model = StringIndexer(
            inputCols=[f"_{c}_text" for c in self.columns],
            outputCols=[f"_{c}_index" for c in self.columns],
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ).fit(self._text(df))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        indexed = self.model.transform(self._text(df))
        sizes = [len(labels) for labels in self.model.labelsArray]
        coded = indexed.withColumns({
            c: F.when(F.col(f"_{c}_index") < n, F.col(f"_{c}_index").cast("int")).otherwise(0)
            for c, n in zip(self.columns, sizes)
        })
        return coded.select(*df.columns)
