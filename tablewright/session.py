"""Session settings, and the shared folder for data that must outlive a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_local_folders: dict[str, str] = {}


def build_session(app: str = "tablewright", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators count on: adaptive plans, skew splitting also
    where it costs a shuffle, and one time zone."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by `spark.checkpoint.dir`.

    A local session (tests) without the setting gets a temporary folder. A cluster without it
    is an error: a folder on one machine would be lost with that machine.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="tablewright-")
    return _local_folders[context.applicationId]


def run_folder(spark: SparkSession) -> str:
    """The folder of all that this application has settled."""
    return os.path.join(shared_dir(spark), f"run-{spark.sparkContext.applicationId}")


def fresh_path(spark: SparkSession, label: str) -> str:
    return os.path.join(run_folder(spark), f"{label}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has settled. Frames that still read it can no longer run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage and pins values that would differ if computed again (generated ids, range
    boundaries), so a lost executor costs a re-read of files and nothing else.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
