"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "surveyalign", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on; sizes are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


@cache
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="surveyalign-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the setting is missing a temporary folder is used, but only when the driver
    and the executors are one process; a cluster without a shared folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_root()
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the application ends."""
    own = f"{shared_root(spark)}/surveyalign/{spark.sparkContext.applicationId}"
    _delete_at_the_end(spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


@cache
def _delete_at_the_end(spark: SparkSession, path: str) -> None:
    """What an application left in the shared folder goes when the application ends."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def release(df: DataFrame) -> None:
    """Delete the stored files of a table that ``materialize`` returned; nothing may read it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/surveyalign/" in file:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@cache
def _package_zip() -> str:
    """The package as a zip file, for executors that do not have it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="surveyalign-package-"), "surveyalign.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "surveyalign")):
            for name in names:
                if name.endswith((".py", ".jsonl")):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, root))
    return path


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in every task, wherever the driver was started from."""
    if not getattr(spark.sparkContext, "_surveyalign_shipped", False):
        spark.sparkContext.addPyFile(_package_zip())
        spark.sparkContext._surveyalign_shipped = True


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later passes scan the table instead of repeating the joins above it, a lost executor
    costs one re-read, and the optimizer sees the true size of the table: it broadcasts
    it only below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    ship_package(df.sparkSession)
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
