"""Inserting rows, frames and query results into declared tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.generators import fill_default, generate, rising_ids
from tablewright.operators.ids import auto_increment
from tablewright.schema import TableSpec
from tablewright.session import settle


def align(
    spec: TableSpec,
    df: DataFrame,
    existing: Callable[[], DataFrame],
    exclude: Sequence[str] = (),
    order: Sequence[Column] = (),
    last: Callable[[str], int | None] = lambda prop: None,
) -> DataFrame:
    """Shape a frame like the table: missing properties become NULL, then generators, defaults
    and types apply, and a NULL where none is allowed fails the write. Generated ids follow the
    last one of a property, which is looked up in the `existing` rows only if `last` does not know."""
    given = set(df.columns) - set(exclude)
    aligned = df.select(
        *[
            (F.col(f"`{c.prop}`") if c.prop in given else F.lit(None))
            .cast(c.data_type)
            .alias(c.prop)
            for c in spec.columns
        ],
        *[c.alias(f"_order{i}") for i, c in enumerate(order)],
    )
    sort = [F.col(f"_order{i}") for i in range(len(order))]
    for c in spec.columns:
        if c.auto_increment:
            aligned = auto_increment(aligned, existing, c.prop, sort, last(c.prop))
        elif c.generator is not None:
            aligned = generate(aligned, c, existing, sort, c.prop in given, last)
        if c.default is not None:
            aligned = fill_default(aligned, c)
    return aligned.select(
        *[
            (F.col(f"`{c.prop}`") if spec.is_nullable(c.prop) else not_null(c.prop))
            .cast(c.data_type)
            .alias(c.prop)
            for c in spec.columns
        ]
    )


def not_null(prop: str):
    value = F.col(f"`{prop}`")
    return F.coalesce(value, F.raise_error(F.lit(f"property {prop!r} must not be null")))


@dataclass(frozen=True)
class Insert:
    tables: Any
    spec: TableSpec
    parts: tuple[DataFrame, ...] = ()
    order: tuple[Any, ...] = ()
    excluded: tuple[str, ...] = field(default=())

    def values(self, rows, exclude: Sequence[str] = ()) -> Insert:
        """Add a mapping, a list of mappings, or a DataFrame of rows."""
        if isinstance(rows, DataFrame):
            df = rows
        else:
            listed = [rows] if isinstance(rows, Mapping) else list(rows)
            df = self.tables.spark.createDataFrame(
                [tuple(r.get(p) for p in self.spec.props) for r in listed], self._row_schema()
            )
        return replace(self, parts=(*self.parts, df), excluded=tuple(exclude))

    def _row_schema(self) -> T.StructType:
        """Types for rows given as Python values: all nullable, since gaps are filled later, and
        decimals unrounded, since the cast to the declared scale rounds them."""
        return T.StructType(
            [
                T.StructField(
                    f.name,
                    T.DecimalType(38, 18) if isinstance(f.dataType, T.DecimalType) else f.dataType,
                )
                for f in self.spec.struct()
            ]
        )

    def values_from(self, query, included: Sequence[str] | None = None) -> Insert:
        """Add a query's rows: by label, or by position for the listed properties. Properties
        that the query does not give get their default or NULL."""
        df, _ = self.tables.source(query)
        if included:
            df = df.toDF(*included)
        return replace(self, parts=(*self.parts, df))

    def in_order(self, *columns) -> Insert:
        """Generated ids follow this order of the rows."""
        return replace(self, order=columns)

    def frame(self) -> DataFrame:
        """The rows as they will be stored, under property names."""
        return self._numbered()[0]

    def _numbered(self) -> tuple[DataFrame, dict[str, int | None]]:
        """The rows, and by column the last ids that the table had noted when they were numbered."""
        df = self.parts[0]
        for more in self.parts[1:]:
            df = df.unionByName(more, allowMissingColumns=True)
        name, store = self.spec.name, self.tables.store
        rising = [c for c in self.spec.columns if rising_ids(c)] if hasattr(store, "last_id") else []
        lasts = {c.prop: store.last_id(name, c.column_name) for c in rising}
        rows = align(
            self.spec, df, lambda: self.tables.table(name), self.excluded, self.order, lasts.get
        )
        return rows, {c.column_name: lasts[c.prop] for c in rising}

    def _append(self, rows: DataFrame, lasts: Mapping[str, int | None]) -> int:
        name = self.spec.name
        return self.tables.store.append(name, self.tables.physical(name, rows), lasts=lasts)

    def execute(self) -> int:
        return self._append(*self._numbered())

    def execute_returning(self) -> DataFrame:
        """Insert and return the keys. The rows are written once before the insert, so that
        generated values are the same in the table and in the result."""
        rows, lasts = self._numbered()
        rows = settle(rows, "inserted")
        self._append(rows, lasts)
        return rows.select(*(self.spec.primary_key or self.spec.props))

    def batch(self, flush_size: int = 100) -> Batch:
        return Batch(self, flush_size)


class Batch:
    """Rows pushed one by one and inserted in chunks of `flush_size`.

    For rows made on the driver. Rows that are in Spark already go in with one `values(frame)`,
    and a stream of rows with `streaming.ingest`.
    """

    def __init__(self, insert: Insert, flush_size: int = 100):
        self.insert = insert
        self.flush_size = flush_size
        self.rows: list[Mapping[str, Any]] = []
        self.inserted = 0

    def push(self, row: Mapping[str, Any]) -> Batch:
        self.rows.append(row)
        if len(self.rows) >= self.flush_size:
            self.flush()
        return self

    def flush(self) -> int:
        rows, self.rows = self.rows, []
        count = self.insert.values(rows).execute() if rows else 0
        self.inserted += count
        return count

    def execute(self) -> int:
        self.flush()
        return self.inserted
