"""Checks that the data keeps what the tables declare. Each returns the violations as a frame.

Keys are grouped before anything else, so a value that repeats in a third of the rows costs one
partial row per task.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.schema import ForeignKey, TableSpec, can_widen


def _cols(props: Sequence[str]) -> list[Column]:
    return [F.col(f"`{p}`") for p in props]


def _any_null(props: Sequence[str]) -> Column:
    return functools.reduce(Column.__or__, [c.isNull() for c in _cols(props)])


def check_primary_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that are NULL in part or occur more than once, with `n` rows each."""
    counts = df.groupBy(*_cols(key)).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(_any_null(key) | (F.col("n") > 1))


def check_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Values that occur more than once; a key with a NULL part is never a duplicate."""
    counts = df.where(~_any_null(key)).groupBy(*_cols(key)).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 1)


def check_foreign_key(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Key values without a parent row, with `n` child rows each; NULL keys refer to nothing."""
    used = (
        child.where(~_any_null(fk.props))
        .groupBy(*_cols(fk.props))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = parent.select(
        *[F.col(f"`{p}`").alias(f"_ref{i}") for i, p in enumerate(fk.ref_props)]
    )
    on = [F.col(f"`{p}`") == F.col(f"_ref{i}") for i, p in enumerate(fk.props)]
    return used.join(known, functools.reduce(Column.__and__, on), "left_anti")


def check_not_null(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Number of NULLs per property that must not be NULL, one pass for all of them."""
    props = [c.prop for c in spec.columns if not spec.is_nullable(c.prop)]
    return _per_property(df, {p: F.col(f"`{p}`").isNull() for p in props})


def check_domains(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Number of values per property that break its length, precision or sign."""
    tests: dict[str, Column] = {}
    for c in spec.columns:
        value = F.col(f"`{c.prop}`")
        found = []
        if c.length is not None:
            size = F.octet_length(value) if isinstance(c.data_type, T.BinaryType) else F.length(value)
            found.append(size > c.length)
        if isinstance(c.data_type, T.DecimalType) and not c.unsigned:
            found.append(value.isNotNull() & value.try_cast(c.data_type).isNull())
        if c.unsigned:
            found.append(value < 0)
        if found:
            tests[c.prop] = functools.reduce(Column.__or__, found)
    return _per_property(df, tests)


def _per_property(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows (property, n) for the tests that hold at least once."""
    if not tests:
        return df.sparkSession.createDataFrame([], "property string, n bigint")
    counted = df.agg(*[F.count_if(t).alias(p) for p, t in tests.items()])
    listed = [F.struct(F.lit(p).alias("property"), F.col(f"`{p}`").alias("n")) for p in tests]
    return counted.select(F.inline(F.array(*listed))).where("n > 0")


def require_keys(df: DataFrame, spec: TableSpec) -> None:
    """Fail unless the frame gives each row of `spec` at most once, by a whole primary key."""
    if not spec.primary_key:
        raise ValueError(f"{spec.name} has no primary key")
    bad = check_primary_key(df, spec.primary_key).first()
    if bad is not None:
        raise ValueError(f"{spec.name}: null or repeated key {bad.asDict()}")


def schema_diff(df: DataFrame, spec: TableSpec, physical: bool = False) -> DataFrame:
    """Where a table differs from its declaration: rows (column, problem, declared, found).

    Types and missing columns come from the schema; lengths and NULLs from one pass over the
    data, since files do not record them.
    """
    fixed: list[tuple[str, str, str, str]] = []
    found = {f.name: f for f in df.schema}
    lengths, nulls = {}, {}
    for c in spec.columns:
        name = c.column_name if physical else c.prop
        if name not in found:
            fixed.append((name, "missing", c.data_type.simpleString(), ""))
            continue
        actual = found[name].dataType
        if actual != c.data_type:
            problem = "widen" if can_widen(actual, c.data_type) else "type"
            fixed.append((name, problem, c.data_type.simpleString(), actual.simpleString()))
        if c.length is not None and isinstance(actual, T.StringType):
            lengths[name] = c.length
        if not spec.is_nullable(c.prop):
            nulls[name] = True
    spark = df.sparkSession
    schema = "column string, problem string, declared string, found string"
    report = spark.createDataFrame(fixed, schema)
    if not lengths and not nulls:
        return report
    measured = df.agg(
        *[F.max(F.length(f"`{n}`")).alias(f"_l{i}") for i, n in enumerate(lengths)],
        *[F.count_if(F.col(f"`{n}`").isNull()).alias(f"_n{i}") for i, n in enumerate(nulls)],
    )
    lines = []
    for i, (name, limit) in enumerate(lengths.items()):
        lines.append(_line(name, "length", str(limit), F.col(f"_l{i}"), F.col(f"_l{i}") > limit))
    for i, name in enumerate(nulls):
        lines.append(_line(name, "nulls", "0", F.col(f"_n{i}"), F.col(f"_n{i}") > 0))
    data = measured.select(F.inline(F.array(*lines))).where("broken").drop("broken")
    return report.union(data)


def _line(name: str, problem: str, declared: str, found: Column, broken: Column) -> Column:
    return F.struct(
        F.lit(name).alias("column"),
        F.lit(problem).alias("problem"),
        F.lit(declared).alias("declared"),
        found.cast("string").alias("found"),
        F.coalesce(broken, F.lit(False)).alias("broken"),
    )
