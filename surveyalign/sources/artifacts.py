"""Fitted state as parquet tables of parameters."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession

from surveyalign.operators.boosting import SoftmaxTrees
from surveyalign.operators.features import OrdinalEncoder, TabularEncoder
from surveyalign.operators.models import ModeChoiceModel
from surveyalign.operators.prototypes import Clustering, PrototypeMemory
from surveyalign.operators.retrieval import RetrievalIndex


def save_prototypes(memory: PrototypeMemory, path: str) -> None:
    spark = memory.prototypes.sparkSession
    memory.encoder.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/encoder")
    memory.clustering.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    memory.prototypes.write.mode("overwrite").parquet(f"{path}/prototypes")


def load_prototypes(spark: SparkSession, path: str) -> PrototypeMemory:
    return PrototypeMemory(
        TabularEncoder.from_frame(spark.read.parquet(f"{path}/encoder")),
        Clustering.from_frame(spark.read.parquet(f"{path}/centers")),
        spark.read.parquet(f"{path}/prototypes"),
    )


def save_memory(memory: DataFrame, encoder: TabularEncoder, path: str, mode: str = "overwrite") -> None:
    """Encoded corpus and encoder; ``mode="append"`` adds rows to a stored memory."""
    memory.write.mode(mode).parquet(f"{path}/memory")
    encoder.to_frame(memory.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{path}/encoder")


def load_memory(spark: SparkSession, path: str) -> tuple[DataFrame, TabularEncoder]:
    return (spark.read.parquet(f"{path}/memory"),
            TabularEncoder.from_frame(spark.read.parquet(f"{path}/encoder")))


def _write_facts(spark: SparkSession, facts: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_facts(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_model(model: ModeChoiceModel, spark: SparkSession, path: str) -> None:
    model.encoder.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/encoder")
    trees = isinstance(model.model, SoftmaxTrees)
    if trees:
        model.model.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    else:
        model.model.write().overwrite().save(f"{path}/model")
    _write_facts(spark, {"classes": model.classes, "clip_negatives": model.clip_negatives, "trees": trees}, f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> ModeChoiceModel:
    facts = _read_facts(spark, f"{path}/facts")
    model = SoftmaxTrees.from_frame(spark.read.parquet(f"{path}/model")) if facts["trees"] else LogisticRegressionModel.load(f"{path}/model")
    return ModeChoiceModel(
        TabularEncoder.from_frame(spark.read.parquet(f"{path}/encoder")), facts["classes"], model, facts["clip_negatives"])


def save_ordinal_encoder(encoder: OrdinalEncoder, spark: SparkSession, path: str) -> None:
    encoder.model.write().overwrite().save(f"{path}/model")
    _write_facts(spark, {"columns": encoder.columns}, f"{path}/facts")


def load_ordinal_encoder(spark: SparkSession, path: str) -> OrdinalEncoder:
    encoder = OrdinalEncoder(_read_facts(spark, f"{path}/facts")["columns"])
    encoder.model = StringIndexerModel.load(f"{path}/model")
    return encoder


def save_index(index: RetrievalIndex, path: str) -> None:
    """The stored rows as tables, and the bounded sample and cell facts as one small table."""
    spark = index.candidates.sparkSession
    index.candidates.write.mode("overwrite").parquet(f"{path}/candidates")
    index.cells.write.mode("overwrite").parquet(f"{path}/cells")
    arrays = [(i, [float(x) for x in row], float(offset)) for i, (row, offset) in enumerate(zip(index.sample, index.sample_offsets))]
    spark.createDataFrame(arrays, "i int, vector array<double>, offset double").coalesce(1).write.mode("overwrite").parquet(f"{path}/sample")
    if index.subcells is not None:
        index.subcells.write.mode("overwrite").parquet(f"{path}/subcells")
    cells = [(i, float(r), float(o), int(c), int(n)) for i, (r, o, c, n) in enumerate(zip(index.cell_radius, index.cell_offset, index.cell_chunks, index.cell_rows))]
    spark.createDataFrame(cells, "i int, radius double, offset double, chunks int, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    _write_facts(spark, {"n_pivots": index.n_pivots, "k": index.k, "divided": index.subcells is not None, "generation": index.generation}, f"{path}/facts")


def load_index(spark: SparkSession, path: str) -> RetrievalIndex:
    facts = _read_facts(spark, f"{path}/facts")
    sample = sorted(spark.read.parquet(f"{path}/sample").collect())   # bounded by the sample size
    bounds = sorted(spark.read.parquet(f"{path}/bounds").collect())   # one row per cell
    return RetrievalIndex(
        spark.read.parquet(f"{path}/candidates"), spark.read.parquet(f"{path}/cells"),
        np.array([r["vector"] for r in sample]) if sample else np.empty((0, 0)), np.array([r["offset"] for r in sample]),
        facts["n_pivots"], np.array([r["radius"] for r in bounds]), np.array([r["offset"] for r in bounds]),
        np.array([r["chunks"] for r in bounds]), facts["k"], np.array([r["n"] for r in bounds]),
        spark.read.parquet(f"{path}/subcells") if facts["divided"] else None, facts["generation"])
