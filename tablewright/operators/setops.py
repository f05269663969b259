"""Set operations by position, with NULLs equal as SQL wants.

INTERSECT and MINUS are one tagged union and one grouping: duplicates and hot rows are combined
inside each task before the only shuffle, where a join of the two sides would send every copy of
a hot row to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b, F.col("_in_a") & F.col("_in_b"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b, F.col("_in_a") & ~F.col("_in_b"))


def _sides(a: DataFrame, b: DataFrame, kept: Column) -> DataFrame:
    """The distinct rows that are kept by which side has them, under the names of the first."""
    names = [f"_s{i}" for i in range(len(a.columns))]
    tagged = a.toDF(*names).withColumn("_from_a", F.lit(True))
    tagged = tagged.union(b.toDF(*names).withColumn("_from_a", F.lit(False)))
    found = tagged.groupBy(*names).agg(
        F.bool_or("_from_a").alias("_in_a"),
        F.bool_or(~F.col("_from_a")).alias("_in_b"),
    )
    return found.where(kept).select(*names).toDF(*a.columns)
