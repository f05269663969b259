"""Writing a stage's rows so that what follows starts from files, not from lineage; shipping the code."""

from __future__ import annotations

import ctypes
import os
import shutil
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import tablewright

from tablewright.session import settle as _settle

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CODEC = "spark.sql.parquet.compression.codec"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = "2000"  # rows that a Python worker gets at once: whole texts are held there more than once


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """`df` written to the shared folder and read back. Its shuffle files go once it is written, so
    the stages of a job do not add up on the executors' disks; what is written is packed tightly."""
    conf = df.sparkSession.conf
    own = {CLEANUP: "true", CODEC: "zstd", BATCH: TEXTS}
    before = {CLEANUP: conf.get(CLEANUP, "false"), CODEC: conf.get(CODEC, "snappy"), BATCH: conf.get(BATCH, "10000")}
    for key, value in own.items():
        conf.set(key, value)
    try:
        return _settle(df, label)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def release() -> None:
    """Gives memory that a task's arrays have left back to the system: workers are reused, and each
    stage of a job would otherwise keep its largest batch."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def releasing(function):
    """A function over the batches of a partition that gives its memory back at the end."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose tasks import it, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top = os.path.dirname(os.path.dirname(os.path.abspath(tablewright.__file__)))
        folder = tempfile.mkdtemp(prefix="tablewright-code-")
        name = os.path.join(folder, "tablewright_code")
        context.addPyFile(shutil.make_archive(name, "zip", top, "tablewright"))
