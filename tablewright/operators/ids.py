"""Row numbers and generated ids without sending the table through one task.

Rows get their position within a partition, one count per partition gives each partition its
offset, and the two add up to a dense index. The placed rows are written first, so a retried task
cannot number them differently.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import settle

POSITION_MASK = (1 << 33) - 1  # low bits of monotonically_increasing_id: position in partition


def dense_index(
    df: DataFrame, order: Sequence[Column] = (), label: str = "idx", block: int = 1
) -> DataFrame:
    """Add `label`: 0, 1, 2, ... in `order`, or in partition order if none is given.

    With `block` > 1 each partition reserves whole blocks of numbers, which leaves gaps.
    """
    if order:
        # Rows equal in `order` keep their input order, and a value shared by many rows can
        # still be cut into several ranges.
        sort = [*order, F.col("_tie")]
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie")
    placed = settle(
        df.select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION_MASK)).alias("_pos"),
        ),
        "placed",
    )
    # One row per partition, so neither the window below nor the broadcast grows with the rows.
    sizes = placed.groupBy("_part").agg(
        (F.ceil(F.count(F.lit(1)) / block) * block).cast("long").alias("_size")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(label, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )


def number_rows(
    df: DataFrame,
    label: str,
    start: int = 0,
    interval: int = 1,
    maximum: int | None = None,
    order: Sequence[Column] = (),
    block: int = 1,
) -> DataFrame:
    """Ids `start`, `start + interval`, ...; an id past `maximum` is an error."""
    value = F.lit(start).cast("long") + F.col("_idx") * F.lit(interval)
    if maximum is not None:
        beyond = value > maximum if interval > 0 else value < maximum
        value = F.when(
            beyond, F.raise_error(F.lit(f"{label}: no id left within {maximum}"))
        ).otherwise(value)
    return dense_index(df, order, "_idx", block).withColumn(label, value).drop("_idx")


def identity_ids(
    df: DataFrame,
    label: str,
    start: int = 0,
    maximum: int = 2**31 - 1,
    interval: int = 1,
    order: Sequence[Column] = (),
) -> DataFrame:
    return number_rows(df, label, start, interval, maximum, order)


def sequence_ids(
    df: DataFrame,
    label: str,
    start_with: int = 1,
    increment_by: int = 1,
    min_value: int = 1,
    max_value: int = -1,
    cache: int = 10,
    order: Sequence[Column] = (),
) -> DataFrame:
    """Ids of a sequence. Each partition takes whole blocks of `cache` ids, so gaps can occur;
    a `max_value` of -1 means none."""
    if increment_by > 0:
        start, bound = max(start_with, min_value), None if max_value == -1 else max_value
    else:
        start, bound = start_with, min_value
    return number_rows(df, label, start, increment_by, bound, order, cache)


def auto_increment(
    df: DataFrame,
    table: DataFrame | Callable[[], DataFrame],
    prop: str,
    order: Sequence[Column] = (),
    highest: int | None = None,
) -> DataFrame:
    """Fill `prop` of the new rows with ids that follow the highest one, looked up in `table` if it is
    not given."""
    if highest is None:
        rows = table if isinstance(table, DataFrame) else table()
        highest = rows.agg(F.max(prop)).first()[0]
    return number_rows(df.drop(prop), prop, (highest or 0) + 1, order=order)
