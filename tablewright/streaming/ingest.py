"""Inserting a stream of rows into a table, each row exactly once."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tablewright.operators.generators import rising_ids
from tablewright.operators.inserts import align

BATCH = "batch_id"


def ingest(
    stream: DataFrame, tables, table: str, path: str, checkpoint: str, rows_per_file: int = 0
) -> DataStreamWriter:
    """A writer that inserts the stream's rows into `path`, shaped like the declared table:
    generators, defaults, types and null checks apply as in any insert.

    Each micro-batch owns the folder `batch_id=N` and overwrites it. A batch that is run again
    after a failure replaces what it may have left behind, so no row is lost or doubled. With its
    rows a batch leaves the last ids it gave, in `_last_ids`, and the next batch goes on from there
    without reading any earlier row.
    """
    spec = tables.catalog[table]
    numbered = [c.prop for c in spec.columns if rising_ids(c)]

    def insert(batch: DataFrame, batch_id: int) -> None:
        def earlier() -> DataFrame:
            if batch_id == 0:
                return batch.sparkSession.createDataFrame([], spec.struct())
            done = _with_batches(batch.sparkSession, path).where(F.col(BATCH) < batch_id)
            return done.withColumnsRenamed(spec.to_property)

        spark = batch.sparkSession
        noted = _last_ids(spark, path, batch_id - 1)
        rows = align(spec, batch, earlier, last=noted.get)
        seen = Observation()
        highest = [F.max(f"`{p}`").alias(p) for p in numbered]
        rows = rows.observe(seen, F.count(F.lit(1)).alias("_n"), *highest)
        writer = tables.physical(table, rows).write.mode("overwrite")
        writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(os.path.join(path, f"{BATCH}={batch_id}"))
        if numbered:
            found = seen.get
            ids = [[v for v in (noted.get(p), found[p]) if v is not None] for p in numbered]
            last = [(p, max(v)) for p, v in zip(numbered, ids, strict=True) if v]
            frame = spark.createDataFrame(last, "prop string, last long").coalesce(1)
            frame.write.mode("overwrite").parquet(_last_folder(path, batch_id))

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)


def _last_folder(path: str, batch_id: int) -> str:
    return os.path.join(path, "_last_ids", str(batch_id))


def _last_ids(spark: SparkSession, path: str, batch_id: int) -> dict[str, int]:
    """The last ids after a batch, a row per numbered property; none if it left none."""
    if batch_id < 0:
        return {}
    try:
        return dict(spark.read.parquet(_last_folder(path, batch_id)).collect())
    except AnalysisException:
        return {}


def _with_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    return _with_batches(spark, path).drop(BATCH)
