"""A workspace ties the declared tables to the place where their data lives."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from tablewright.functions.predicates import by_identity, eq
from tablewright.functions.scope import Source
from tablewright.operators.cascade import Delete, KeyUpdate
from tablewright.operators.inserts import Insert
from tablewright.operators.joins import thin
from tablewright.operators.query import ROOT, Query
from tablewright.operators.updates import Update, update_by_key
from tablewright.schema import Catalog, TableSpec
from tablewright.session import clear_scratch
from tablewright.sources.tables import FolderStore, TableStore


class Workspace:
    def __init__(self, spark: SparkSession, catalog: Catalog, store):
        self.spark = spark
        self.catalog = catalog
        self.store = store
        self.queries: dict[str, Query] = {}
        self._results: dict[str, DataFrame] = {}
        self.versions: dict[str, str | None] = {}  # of the tables when last read

    @staticmethod
    def over_files(spark: SparkSession, catalog: Catalog, folder: str) -> Workspace:
        """Read-only tables, one parquet file or folder each."""
        return Workspace(spark, catalog, FolderStore(spark, folder))

    @staticmethod
    def over_tables(
        spark: SparkSession, catalog: Catalog, database: str, location: str
    ) -> Workspace:
        """Tables of a Spark database, with their files below `location`."""
        return Workspace(spark, catalog, TableStore(spark, database, location))

    # ---- reading -------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """A table under its property names, with the declared types if it is declared."""
        if hasattr(self.store, "version") and self.store.exists(name):
            self.versions[name] = self.store.version(name)
        if name not in self.catalog:
            return self.store.read(name)
        spec = self.catalog[name]
        df = self.store.read(name, spec.struct(physical=True))
        return df.withColumnsRenamed(spec.to_property)

    def found(self, name: str) -> DataFrame:
        """A declared table with the columns and types that its files have."""
        return self.store.read(name).withColumnsRenamed(self.catalog[name].to_property)

    def source(self, source) -> tuple[DataFrame, Source]:
        if isinstance(source, str):
            df = self.table(source)
            spec = self.catalog[source] if source in self.catalog else None
            return df, Source(tuple(df.columns), spec)
        if isinstance(source, Query):
            df = source.frame()
            return df, source.described(df)
        return source, Source(tuple(source.columns))

    def query(self, source, alias: str = ROOT) -> Query:
        return Query.over(self, source, alias)

    def get(self, table: str, key: Any) -> DataFrame:
        """The row with this primary key: one value, or a mapping for a composite key."""
        spec = self.catalog[table]
        if isinstance(key, Mapping):
            condition = by_identity(spec, key)
        elif len(spec.primary_key) == 1:
            condition = eq(spec.primary_key[0], key)
        else:
            raise ValueError(f"the key of {table} has the parts {spec.primary_key}: give a mapping")
        return self.query(table).filter(condition).limit(1).frame()

    def by_examples(
        self,
        table: str,
        examples: DataFrame,
        exclude: Sequence[str] = (),
        selector: str = "NON_NULL",
    ) -> Query:
        """Rows like any of a frame of examples; a NULL in an example matches every value, with the
        selector `NON_NULL_OR_ZERO` a zero too, and with `ALL` NULL matches NULL only.

        An example's shape is the set of properties that it gives. Every row is looked up once per shape
        that occurs, by that shape and its own values of these properties, in one semi join; rows that
        more than one example matches are then reduced to one. The shapes stay in Spark.
        """
        props = [p for p in examples.columns if p not in set(exclude)]
        frame, described = self.source(table)
        names = [f"_example{i}" for i in range(len(props))]
        given = [_is_given(F.col(f"`{p}`"), examples.schema[p].dataType, selector) for p in props]
        shape = F.concat(F.lit("s"), *[F.when(g, "1").otherwise("0") for g in given])
        wanted = examples.select(
            shape.alias("_shape"),
            *[F.when(g, F.col(f"`{p}`")).alias(n) for g, p, n in zip(given, props, names, strict=True)],
        )
        shapes = wanted.select(F.collect_set("_shape").alias("shapes")).scalar()
        rows = frame.withColumn("_row", F.monotonically_increasing_id()).withColumn("_wanted", F.explode(shapes))
        wanted = thin(wanted, F.col("_shape"), *[F.col(n) for n in names])
        same = F.col("_wanted") == F.col("_shape")
        for i, (p, n) in enumerate(zip(props, names, strict=True)):
            own = F.when(F.substring("_wanted", i + 2, 1) == "1", F.col(f"`{p}`"))
            same &= own.eqNullSafe(F.col(n))
        found = rows.join(wanted, same, "left_semi").dropDuplicates(["_row"])
        return Query.over_frame(self, found.select(*[f"`{c}`" for c in frame.columns]), described)

    def sql(self, text: str, args: Mapping[str, Any] | Sequence[Any] = ()) -> DataFrame:
        """SQL text with bound parameters. Declared tables it names are views under their name."""
        for name in self.catalog.specs:
            if re.search(rf"\b{re.escape(name)}\b", text) and self.store.exists(name):
                self.physical(name, self.table(name)).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args or None)

    # ---- named queries and results -------------------------------------------------------

    def named(self, name: str) -> Query:
        """A query over a query that was given this name."""
        return self.query(self.queries[name])

    def cached(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A result computed once under a name and kept in executor memory or on disk."""
        if name not in self._results:
            self._results[name] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._results[name]

    def evict(self, name: str) -> None:
        df = self._results.pop(name, None)
        if df is not None:
            df.unpersist()

    # ---- changing ------------------------------------------------------------------------

    def insert(self, table: str) -> Insert:
        return Insert(self, self.catalog[table])

    def save(self, table: str, row: Mapping[str, Any]) -> DataFrame:
        """Insert one row; returns its keys, also the generated ones."""
        return self.insert(table).values(row).execute_returning()

    def update(self, table: str, alias: str = ROOT) -> Update:
        return Update(self, self.catalog[table], alias)

    def update_object(self, table: str, row: Mapping[str, Any], exclude: Sequence[str] = ()):
        """Set the row's non-null properties in the table row with the same primary key."""
        spec = self.catalog[table]
        given = [p for p in spec.props if p in row]
        schema = self.table(table).select(*given).schema
        changes = self.spark.createDataFrame([tuple(row[p] for p in given)], schema)
        return update_by_key(self, spec, changes, exclude)

    def update_by_key(
        self,
        table: str,
        changes: DataFrame,
        exclude: Sequence[str] = (),
        selector: str = "NON_NULL",
    ):
        return update_by_key(self, self.catalog[table], changes, exclude, selector)

    def update_keys(self, table: str) -> KeyUpdate:
        """Change key values, with the declared `on_update` actions on the tables below."""
        return KeyUpdate(self, self.catalog[table])

    def delete(self, table: str, alias: str = ROOT) -> Delete:
        return Delete(self, self.catalog[table], alias)

    def delete_object(self, table: str, row: Mapping[str, Any], cascade: bool = False):
        spec = self.catalog[table]
        removal = self.delete(table).filter(by_identity(spec, row))
        return removal.cascade() if cascade else removal.plan()

    def delete_by_key(self, table: str, keys: DataFrame):
        """Delete the rows whose primary key is in the frame."""
        return self.delete(table).matching(keys).plan()

    def apply(self, change) -> dict[str, int]:
        """Write a planned change; returns the number of affected rows per table.

        All new tables are written before any is switched to, and then one after the other, children
        before parents. If one of them has changed since the plan was made, nothing is switched and a
        `Conflict` is raised: plan the change anew.
        """
        order = self.catalog.parents_first(change.parts)[::-1]
        counts, before, frames, touched = {}, {}, {}, {}
        for name in order:
            part, by = change.parts[name], self.catalog[name].partition_by
            frame = part.frame
            if by and not part.changed & set(by):
                hit = part.affected.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).collect()
                counts[name] = sum(row["_n"] for row in hit)
                touched[name] = [tuple(row[c] for c in by) for row in hit]
                frame = frame.where(_one_of(frame, by, touched[name]))
            elif part.marked is not None:
                frame = part.marked
            elif part.changed:
                counts[name] = part.affected.count()
            else:
                before[name] = self.store.read(name).count()  # from file footers
            frames[name] = self.physical(name, frame)
        after = self.store.replace(frames, touched, change.versions)
        counts |= {name: n - after[name] for name, n in before.items()}
        return {name: counts.get(name, after[name]) for name in order}

    def close(self, scratch: bool = False) -> None:
        """Drop cached results, and the tables that exist only for this workspace. With `scratch`
        also the rows that operators of this application have written in between: for when no frame
        is read any more."""
        for name in list(self._results):
            self.evict(name)
        if hasattr(self.store, "close"):
            self.store.close()
        if scratch:
            clear_scratch(self.spark)

    def physical(self, name: str, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(self.catalog[name].to_physical)

    def spec(self, name: str) -> TableSpec:
        return self.catalog[name]


def _is_given(value: Column, kind: DataType, selector: str) -> Column:
    """Whether an example asks for this value."""
    if selector == "ALL":
        return F.lit(True)
    if selector == "NON_NULL_OR_ZERO" and isinstance(kind, NumericType):
        return F.coalesce(value != 0, F.lit(False))
    if selector not in ("NON_NULL", "NON_NULL_OR_ZERO"):
        raise ValueError(f"unknown selector {selector!r}")
    return value.isNotNull()


def _one_of(df: DataFrame, columns: Sequence[str], values: list[tuple]) -> Column:
    """The columns hold one of the listed rows, NULLs being equal. One set, however many there are; it
    names partition columns only, so that a scan is cut to these partitions before it starts."""

    def packed(cells) -> Column:
        return F.struct(*[v.cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, cells, strict=True)])

    listed = [packed(map(F.lit, row)) for row in values]
    return packed(F.col(f"`{c}`") for c in columns).isin(listed) if listed else F.lit(False)
