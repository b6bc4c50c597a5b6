"""Prediction sets and metric files, one run per (model, ratio, seed)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.operators.metrics import confusion_cube, evaluate_cube
from surveyalign.operators.report import RUN_KEYS, run_columns, run_name
from surveyalign.session import materialize


def _file_path():
    return F.regexp_replace(F.col("_metadata.file_path"), "%3D", "=")


def _run_stem(path):
    """The run a file belongs to: its ``run=`` directory, else its own name without suffix."""
    directory = F.regexp_extract(path, r"/run=([^/]+)/", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.(json|parquet)$", "")
    return F.when(directory != "", directory).otherwise(stem)


#: A task holds this many runs open at a time, each with a row group of ROW_GROUP bytes at most.
OPEN_RUNS = 64
ROW_GROUP = 4 << 20


def write_prediction_sets(predictions: DataFrame, path: str) -> None:
    """All runs in one job, one directory each, named ``{model}_ratio{r}_seed{s}``.

    A task keeps a file open for every run, so rows are written as they come; only those of runs
    beyond OPEN_RUNS are sorted by run first, which would spill whole rows of a large table.
    """
    name = run_name(F.col("model"), F.col("fewshot_ratio"), F.col("seed"))
    conf, setting = predictions.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(setting)
    conf.set(setting, str(OPEN_RUNS))
    try:
        (predictions.withColumn("run", name).drop(*RUN_KEYS)
         .write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("run").parquet(path))
    finally:
        conf.set(setting, before)


def read_prediction_sets(spark: SparkSession, path: str) -> DataFrame:
    """Every prediction file below ``path`` with model, ratio and seed taken from its name.

    The name is taken apart once per file, not once per row; rows meet it by the file they are in.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    named = _prediction_files(spark, path).select("file", _run_stem(F.regexp_replace("file", "%3D", "=")).alias("source_file"))
    named = materialize(named.select("*", *run_columns(F.col("source_file"))), "run-files")
    found = rows.select("*", F.col("_metadata.file_path").alias("_file")).join(named.withColumnRenamed("file", "_file"), "_file", "left")
    return found.drop("_file")


def _tally(rows: DataFrame, subgroups: list[str], weight: str | None) -> DataFrame:
    """The tally of every file; its name is taken apart once per line of the tally, not once per row."""
    cube = confusion_cube(rows.select("*", F.col("_metadata.file_path").alias("file")), ["file"], subgroups, weight=weight)
    named = cube.select("*", *run_columns(_run_stem(F.regexp_replace("file", "%3D", "="))))
    return named.select(*RUN_KEYS, *cube.columns)


_VERSION = ["file", "modified", "length"]


def _prediction_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and version of every prediction file; the files are listed, not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return listed.select("path", F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("modified"), "length")


def _state(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def tally_new_files(
    spark: SparkSession, path: str, state: str, subgroups: list[str] = fv.SUBGROUP_COLUMNS, weight: str | None = "trip_weight",
) -> DataFrame:
    """Tally the prediction files below ``path`` that ``state`` does not know; returns those it read (file, modified, length).

    The state keeps one tally per version of a file: its size is bounded by the code lists times the
    files. A replaced file is read again, and its old tally no longer counts. The list of a batch is
    written after its tally, so a run that stops in between leaves nothing that counts.
    """
    current, known = materialize(_prediction_files(spark, path), "files"), _state(spark, f"{state}/files")
    new = current if known is None else current.join(known.select(*_VERSION), _VERSION, "left_anti")
    paths = [r["path"] for r in new.select("path").collect()]   # the reader takes a list of files
    batch = uuid.uuid4().hex
    if paths:
        tally = _tally(spark.read.parquet(*paths), subgroups, weight)
        tally.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{state}/cube")
        current.where(F.col("path").isin(paths)).select(*_VERSION, F.lit(batch).alias("batch")).write.mode("append").parquet(f"{state}/files")
    done = _state(spark, f"{state}/files")
    if done is None:
        raise FileNotFoundError(f"no prediction files below {path}")
    return done.where(F.col("batch") == batch).select(*_VERSION)


def evaluate_tallied(spark: SparkSession, path: str, state: str, subgroups: list[str] = fv.SUBGROUP_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """The two results of ``evaluate_all`` for the present files below ``path``, from their tallies alone."""
    present = _prediction_files(spark, path).join(_state(spark, f"{state}/files"), _VERSION).select("file", "batch")
    tallies = _state(spark, f"{state}/cube").join(present, ["file", "batch"])
    cube = tallies.groupBy(*RUN_KEYS, *subgroups, "y_true", "y_pred").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    return evaluate_cube(materialize(cube, "cube"), RUN_KEYS, subgroups)


def write_metrics(metrics: DataFrame, path: str, prefix_model: bool = True) -> None:
    """One JSON object per run from the long table; keys are ``{model}_{metric}``."""
    name = F.concat(F.col("model"), F.lit("_"), F.col("metric")) if prefix_model else F.col("metric")
    objects = metrics.groupBy(*RUN_KEYS).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, F.col("value")))))).alias("value"))
    run = run_name(F.col("model"), F.col("fewshot_ratio"), F.col("seed"))
    objects.select("value", run.alias("run")).write.mode("overwrite").partitionBy("run").text(path)


def write_subgroup_metrics(subgroups: DataFrame, path: str) -> None:
    """The second table of ``evaluate_all``: one JSON list per run, an object per subgroup value."""
    others = [c for c in subgroups.columns if c not in RUN_KEYS]
    rows = F.to_json(F.sort_array(F.collect_list(F.struct(*others))))
    run = run_name(F.col("model"), F.col("fewshot_ratio"), F.col("seed"))
    objects = subgroups.groupBy(*RUN_KEYS).agg(rows.alias("value"))
    objects.select("value", run.alias("run")).write.mode("overwrite").partitionBy("run").text(path)


def load_subgroup_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_subgroup_metrics`` with the run's name."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = F.from_json("value", "array<struct<subgroup string, subgroup_value int, n_trips long, mode_share_mae double, mode_share_js double>>")
    return text.select(_run_stem(_file_path()).alias("source_file"), F.inline(rows))


def load_all_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All JSON objects below ``path`` as rows (source_file, metric, value).

    The keys of different files may differ; a file that is no JSON object is left out.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    parsed = text.select(
        _run_stem(_file_path()).alias("source_file"),
        F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").alias("object"))
    return (
        parsed.where(F.col("object").isNotNull())
        .select("source_file", F.explode("object").alias("metric", "item"))
        .select("source_file", "metric", F.try_variant_get("item", "$", "double").alias("value"))
    )


def unreadable_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The files ``load_all_metrics`` leaves out."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    bad = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").isNull()
    return text.where(bad).select(_run_stem(_file_path()).alias("source_file"))
