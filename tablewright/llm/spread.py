"""Sums over all earlier rows of a group, without one task for a group.

Rows are ordered by a hash-random key, so equal ranges of the key hold equal shares of a group. Each
range (a cell) is summed on its own, the cells of a group are summed up in key order, and a row
adds the rows before it within its cell. The largest sort is one cell: the share 1 / `cells` of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.stages import settle

KEY_BITS = 60


def random_key(seed: str, *parts: Column) -> Column:
    """A number below 2**60 from the md5 of `seed` and the parts; SQL engines agree on it."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def cell_of(key: Column, cells: int) -> Column:
    """The range of `key`; `cells` is a power of two."""
    return F.shiftright(key, KEY_BITS - (cells.bit_length() - 1)).cast("int")


def cell_sums(df: DataFrame, group: str, key: str, value: str, cells: int = 4096) -> DataFrame:
    """(`group`, cell, n, value) per range, written: everything else about a group follows from it.

    It has at most `cells` rows per group, and never more rows than `df`.
    """
    return settle(
        df.groupBy(F.col(group), cell_of(F.col(key), cells).alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(value).alias("value")
        ),
        "cells",
    )


def sum_before(
    df: DataFrame,
    sums: DataFrame,
    group: str,
    key: str,
    value: str,
    ties: list[Column],
    out: str,
    cells: int = 4096,
) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of `group` with a smaller (`key`, ties).

    `group` must not be null. `sums` comes from `cell_sums` over the same rows.
    """
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        group, "cell", F.coalesce(F.sum("value").over(before), F.lit(0)).alias("offset")
    )
    earlier = (
        Window.partitionBy(group, "cell")
        .orderBy(F.col(key), *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.withColumn("cell", cell_of(F.col(key), cells))
        .withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
        .join(offsets, [group, "cell"])
        .withColumn(out, F.col(out) + F.col("offset"))
        .drop("cell", "offset")
    )
