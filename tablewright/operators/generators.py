"""Values for properties that arrive empty: declared generators and defaults."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.ids import identity_ids, sequence_ids
from tablewright.schema import Column
from tablewright.session import settle


@dataclass(frozen=True)
class Identity:
    start: int = 0
    maximum: int = 2**31 - 1
    interval: int = 1

    def number(self, df: DataFrame, label: str, order, last: int | None) -> DataFrame:
        start = self.start if last is None else last + self.interval
        return identity_ids(df, label, start, self.maximum, self.interval, order)


@dataclass(frozen=True)
class IdSequence:
    start_with: int = 1
    increment_by: int = 1
    min_value: int = 1
    max_value: int = -1
    cache: int = 10

    def number(self, df: DataFrame, label: str, order, last: int | None) -> DataFrame:
        return sequence_ids(
            df,
            label,
            self.start_with if last is None else last + self.increment_by,
            self.increment_by,
            self.min_value,
            self.max_value,
            self.cache,
            order,
        )


# Generators known by name.
NAMED = {
    "guid": lambda: F.uuid(),
    "now": lambda: F.localtimestamp(),
    "current_timestamp": lambda: F.localtimestamp(),
    "identity": Identity(),
    "sequence": IdSequence(),
}


def _made(column: Column):
    made = column.generator
    return NAMED[made] if isinstance(made, str) else made


def _rises(made) -> bool:
    return getattr(made, "interval", getattr(made, "increment_by", 1)) > 0


def rising_ids(column: Column) -> bool:
    """Whether inserts number the column upwards, so that the highest id is the last."""
    made = _made(column)
    return column.auto_increment or (hasattr(made, "number") and _rises(made))


def generate(
    df: DataFrame,
    column: Column,
    existing: Callable[[], DataFrame],
    order: Sequence[SparkColumn] = (),
    given: bool = True,
    known: Callable[[str], int | None] = lambda prop: None,
) -> DataFrame:
    """Fill the column's NULLs from its generator. Only rows without a value take an id, and
    ids go on from the last one that is `known`, or else exists."""
    made = _made(column)
    prop = column.prop
    value = F.col(f"`{prop}`")
    if not hasattr(made, "number"):
        return df.withColumn(prop, F.coalesce(value, made().cast(column.data_type)))
    last = known(prop) if _rises(made) else None
    if last is None:
        last = existing().agg((F.max if _rises(made) else F.min)(value)).first()[0]
    if not given:
        return made.number(df.drop(prop), prop, order, last)
    df = settle(df, "given")  # read twice below, and must be the same rows both times
    empty = made.number(df.where(value.isNull()).drop(prop), prop, order, last)
    empty = empty.withColumn(prop, value.cast(column.data_type))
    return df.where(value.isNotNull()).unionByName(empty)


def default_value(column: Column) -> SparkColumn:
    """The declared default: a value, or what a function makes."""
    return column.default() if callable(column.default) else F.lit(column.default)


def fill_default(df: DataFrame, column: Column) -> DataFrame:
    """The declared default replaces NULL and never a given value."""
    value = default_value(column).cast(column.data_type)
    return df.withColumn(column.prop, F.coalesce(F.col(f"`{column.prop}`"), value))
