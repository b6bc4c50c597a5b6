"""Feed newly labelled trips and subgroup errors into stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surveyalign.operators.features import TabularEncoder
from surveyalign.operators.retrieval import upsert_subgroup_errors


def feed_memory(
    trips: DataFrame, encoder: TabularEncoder, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append a stream of canonical trips, encoded as the memory is, to the memory table.

    The file sink records what each batch wrote, so a restarted query adds no row twice.
    """
    writer = (
        encoder.transform(trips).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below ``path``; a version that was being written has no mark yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def read_subgroup_errors(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the table that ``feed_subgroup_errors`` keeps; None before the first."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={versions[-1]}") if versions else None


def merge_errors(path: str, keys: list[str], keep: int = 3):
    """Batch function of a stream of (keys, error): batch n and the version before it give version n.

    A batch that is played again writes its version again from the same two inputs, so it changes
    nothing. Of rows for one subgroup within a batch the largest error counts. The last ``keep``
    versions stay for readers that have begun.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < number]
        new = batch.groupBy(*keys).agg(F.max("error").alias("error"))
        if before:
            new = upsert_subgroup_errors(spark.read.parquet(f"{path}/version={before[-1]}"), new, keys)
        new.write.mode("overwrite").parquet(f"{path}/version={number}")
        for old in before[:-keep]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return run


def feed_subgroup_errors(errors: DataFrame, path: str, checkpoint: str, keys: list[str], available_now: bool = True) -> StreamingQuery:
    """Merge a stream of subgroup errors (keys, error) into the table below ``path``."""
    writer = errors.select(*keys, "error").writeStream.foreachBatch(merge_errors(path, keys)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
