"""Where table data lives: a folder of parquet files to read, or tables of a Spark database."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.fields import sql_literal


class FolderStore:
    """Read-only tables, one `NAME.parquet` file or folder each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """A table; with a schema, files need not be opened to learn theirs."""
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def exists(self, name: str) -> bool:
        try:
            self.read(name)
        except AnalysisException:
            return False
        return True


class Conflict(RuntimeError):
    """A table has changed since the change about to be applied was planned."""


VERSION = "tablewright.version"
CONTENTS = "tablewright.contents"  # noted anew whenever rows are replaced, not when they are added
HIT = "_hit"  # marks rows that a change affects; it is counted and not stored
LAST = "tablewright.last."  # and a column: the highest id that its rows hold


class TableStore:
    """Parquet tables in a Spark database.

    A table's files are never changed. A rewrite goes to a new folder, and the table is then
    pointed at it, so running readers keep the old files and a failed job leaves no trace. Of a
    partitioned table only the partitions that a change affects are rewritten.

    Every change of a table gives it a new version, and a change planned on another version is a
    `Conflict`. Versions are compared right before the switch, without a lock, and tables are switched one
    after the other: writers that meet within that moment, or a driver that dies in it, are for a
    table format with transactions to deal with.
    """

    def __init__(self, spark: SparkSession, database: str, location: str):
        self.spark = spark
        self.database = database
        self.location = location
        self._temporary: list[str] = []
        spark.sql(
            f"CREATE DATABASE IF NOT EXISTS `{database}` "
            f"LOCATION {sql_literal(os.path.join(location, 'database'))}"
        )

    # ---- versions ------------------------------------------------------------------------

    def _properties(self, name: str) -> dict[str, str]:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.full(name)}").collect()
        return {r["key"]: r["value"] for r in rows}

    def _note(self, name: str, values: Mapping[str, str]) -> None:
        listed = ", ".join(f"{sql_literal(k)} = {sql_literal(v)}" for k, v in values.items())
        self.spark.sql(f"ALTER TABLE {self.full(name)} SET TBLPROPERTIES ({listed})")

    def version(self, name: str) -> str | None:
        """The table's version; None before its first change here."""
        return self._properties(name).get(VERSION)

    def last_id(self, name: str, column: str) -> int | None:
        """The highest id in a column that inserts number, None if no insert has noted it."""
        value = self._properties(name).get(LAST + column)
        return None if value is None else int(value)

    def _reserve(self, name: str, df: DataFrame, lasts: Mapping[str, int | None]) -> None:
        """Note the highest ids of rows about to be added, if no other insert has done so since `lasts`
        were read: the next insert goes on behind them from now on, whether this one ends or not."""
        found = df.agg(*[F.max(f"`{c}`").alias(f"_{c}") for c in lasts]).first()
        noted = {}
        for column, last in lasts.items():
            ids = [v for v in (last, found[f"_{column}"]) if v is not None]
            if last is None:  # the one time that all rows are looked at
                ids += [v for v in self.read(name).agg(F.max(f"`{column}`")).first() if v is not None]
            if ids:
                noted[LAST + column] = str(max(ids))
        known = self._properties(name)
        for column, last in lasts.items():
            if known.get(LAST + column) != (None if last is None else str(last)):
                raise Conflict(f"another insert has taken ids of {name}.{column}: insert again")
        if noted:
            self._note(name, noted)

    def _expect(self, expected: Mapping[str, str | None]) -> None:
        moved = [n for n, v in expected.items() if self.version(n) != v]
        if moved:
            raise Conflict(f"{', '.join(moved)} changed since this change was planned")

    def full(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    def _new_folder(self, name: str) -> str:
        return os.path.join(self.location, name, f"v-{uuid.uuid4().hex}")

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        return self.spark.table(self.full(name))

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{name}")

    def partition_columns(self, name: str) -> list[str]:
        columns = self.spark.catalog.listColumns(f"{self.database}.{name}")
        return [c.name for c in columns if c.isPartition]

    def create(self, name: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> None:
        self._save_as(name, self.spark.createDataFrame([], schema), partition_by)

    def create_as(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        """Create a table from a frame; returns the number of rows. An existing one is an error."""
        if self.exists(name):
            raise ValueError(f"table {name} exists")
        return self._save_as(name, df, partition_by)

    def _save_as(self, name: str, df: DataFrame, partition_by: Sequence[str]) -> int:
        counted, seen = _counting(df)
        writer = counted.write.format("parquet").mode("errorifexists").partitionBy(*partition_by)
        writer.option("path", self._new_folder(name)).saveAsTable(self.full(name))
        return seen()

    def append(
        self,
        name: str,
        df: DataFrame,
        rows_per_file: int = 0,
        lasts: Mapping[str, int | None] | None = None,
    ) -> int:
        """Add rows, columns by name; returns their number. `lasts` are the columns that the rows number,
        with the last ids they go on from; ids that another insert has taken meanwhile are a `Conflict`,
        and so is a table whose rows are replaced while rows are added: they may be in its old files."""
        aligned = df.select(*[f"`{c}`" for c in self.read(name).columns])
        contents = self._properties(name).get(CONTENTS)
        if lasts:
            self._reserve(name, aligned, lasts)
        counted, seen = _counting(self._gathered(name, aligned))
        counted.write.option("maxRecordsPerFile", rows_per_file).insertInto(self.full(name))
        if self._properties(name).get(CONTENTS) != contents:
            raise Conflict(f"the rows of {name} were replaced while others were added: look which are there")
        self._note(name, {VERSION: uuid.uuid4().hex})  # plans made before are out of date
        return seen()

    def _gathered(self, name: str, df: DataFrame) -> DataFrame:
        """For a partitioned table, rows of a partition come together before they are written,
        which avoids one small file per task; a large partition still goes to several tasks."""
        columns = self.partition_columns(name)
        return df.hint("rebalance", *[f"`{c}`" for c in columns]) if columns else df

    def replace(
        self,
        frames: dict[str, DataFrame],
        touched: Mapping[str, list[tuple]] | None = None,
        expected: Mapping[str, str | None] | None = None,
    ) -> dict[str, int]:
        """Give tables new contents, one after the other once all of them are written; returns the
        number of rows written, of a frame with a column `HIT` of those for which it is true. A table
        whose version is not the expected one is a `Conflict`, and then none is switched.

        For a table in `touched`, the frame holds these partitions only, and the others stay.
        """
        self._expect(expected or {})
        written, counts = {}, {}
        for name, df in frames.items():
            written[name] = self._new_folder(name)
            seen = Observation()
            hits = F.col(HIT) if HIT in df.columns else F.lit(False)
            # Counted behind the rebalance: adaptive plans drop what is in front of one without rows.
            counted = self._gathered(name, df).observe(
                seen, F.count(F.lit(1)).alias("n"), F.count_if(hits).alias("hits")
            )
            writer = counted.drop(HIT).write.partitionBy(*self.partition_columns(name))
            writer.parquet(written[name])
            found = seen.get
            counts[name] = found["hits"] if HIT in df.columns else found["n"]
        self._expect(expected or {})
        for name, path in written.items():
            self._switch(name, path, frames[name].drop(HIT).schema, (touched or {}).get(name))
        return counts

    def _switch(self, name: str, path: str, schema: T.StructType, gone: list[tuple] | None) -> None:
        """Point a table, or those of its partitions that are written anew, at a new folder."""
        old = {f.name: f.dataType for f in self.read(name).schema}
        partitions = self.partition_columns(name)
        noted = [k for k in self._properties(name) if k.startswith(LAST)]
        if old != {f.name: f.dataType for f in schema}:
            statements, noted = self._declare_at(name, path, schema, partitions), []
        elif partitions:
            if gone is None:
                gone = [tuple(r) for r in self.read(name).select(*partitions).distinct().collect()]
            statements = self._switch_partitions(name, path, schema, partitions, gone)
        else:
            statements = [f"ALTER TABLE {self.full(name)} SET LOCATION {sql_literal(path)}"]
        if noted:  # the new contents may hold other ids
            keys = ", ".join(sql_literal(k) for k in noted)
            statements.append(f"ALTER TABLE {self.full(name)} UNSET TBLPROPERTIES IF EXISTS ({keys})")
        for statement in statements:
            self.spark.sql(statement)
        self._note(name, {VERSION: uuid.uuid4().hex, CONTENTS: uuid.uuid4().hex})
        self.spark.catalog.refreshTable(self.full(name))

    def _switch_partitions(
        self, name: str, path: str, schema: T.StructType, columns: list[str], gone: list[tuple]
    ) -> list[str]:
        """Point partitions at their new folders, and drop those that have no rows any more."""
        file_path = F.col("_metadata.file_path")
        folder = F.regexp_extract(file_path, "^(.*)/[^/]*$", 1)
        found = self.spark.read.schema(schema).parquet(path).groupBy(*columns)
        fresh = {
            tuple(row[c] for c in columns): unquote(row["folder"])
            for row in found.agg(F.any_value(folder).alias("folder")).collect()
        }
        known = {tuple(r) for r in self.read(name).select(*columns).distinct().collect()} & fresh.keys()
        table = f"ALTER TABLE {self.full(name)}"
        listed = [
            f"{table} {_partition(columns, key)} SET LOCATION {sql_literal(fresh[key])}" for key in known
        ]
        if added := fresh.keys() - known:
            places = [f"{_partition(columns, key)} LOCATION {sql_literal(fresh[key])}" for key in added]
            listed.append(f"{table} ADD IF NOT EXISTS {' '.join(places)}")
        if emptied := set(gone) - fresh.keys():
            listed.append(f"{table} DROP IF EXISTS {', '.join(_partition(columns, k) for k in emptied)}")
        # Partitions added from now on lie here, and not where dropped ones have left their files.
        listed.append(f"{table} SET LOCATION {sql_literal(path)}")
        return listed

    def _declare_at(
        self, name: str, path: str, schema: T.StructType, partitions: list[str]
    ) -> list[str]:
        """Declare the table anew over files of another schema. The old files stay where they are."""
        text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in partitions)})" if partitions else ""
        listed = [
            f"DROP TABLE IF EXISTS {self.full(name)}",
            f"CREATE TABLE {self.full(name)} ({text}) USING parquet {by} LOCATION {sql_literal(path)}",
        ]
        if partitions:
            listed.append(f"MSCK REPAIR TABLE {self.full(name)}")
        return listed

    # ---- declarations --------------------------------------------------------------------

    def add_columns(
        self, name: str, columns: Sequence[tuple[str, T.DataType, object, str | None]]
    ) -> None:
        """Declare more columns: name, type, default and comment. Rows written before have the default;
        no file is written."""
        self.spark.sql(f"ALTER TABLE {self.full(name)} ADD COLUMNS ({_declared(columns)})")
        self._note(name, {VERSION: uuid.uuid4().hex})
        self.spark.catalog.refreshTable(self.full(name))

    def comment(self, name: str, comments: Mapping[str, str]) -> None:
        for column, text in comments.items():
            self.spark.sql(
                f"ALTER TABLE {self.full(name)} ALTER COLUMN `{column}` COMMENT {sql_literal(text)}"
            )

    def widen(self, name: str, types: Mapping[str, T.DataType]) -> None:
        """Declare a table without partitions anew, over the same files, with wider types for some
        columns. The files are read as the wider types and not written."""
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.full(name)}").collect()
        place = next(r["data_type"] for r in described if r["col_name"] == "Location")
        known = {k: v for k, v in self._properties(name).items() if k.startswith("tablewright.")}
        columns = [
            (f.name, types.get(f.name, f.dataType), _Raw(f.metadata.get("EXISTS_DEFAULT")), f.metadata.get("comment"))
            for f in self.read(name).schema
        ]
        self.spark.sql(f"DROP TABLE {self.full(name)}")  # the files stay
        self.spark.sql(
            f"CREATE TABLE {self.full(name)} ({_declared(columns)}) USING parquet LOCATION {sql_literal(place)}"
        )
        self._note(name, known | {VERSION: uuid.uuid4().hex})

    def truncate(self, name: str) -> None:
        self.replace({name: self.read(name).where(F.lit(False))})

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.full(name)}")

    def drop_at_close(self, name: str) -> None:
        self._temporary.append(name)

    def close(self) -> None:
        for name in self._temporary:
            self.drop(name)
        self._temporary.clear()

    def export(self, name: str, path: str, file_format: str = "parquet") -> None:
        self.read(name).write.format(file_format).save(path)


class _Raw(str):
    """SQL text of a default as a table has noted it."""

    def __new__(cls, text: str | None):
        return None if text is None else super().__new__(cls, text)


def _declared(columns) -> str:
    listed = []
    for column, kind, default, comment in columns:
        kind = kind.simpleString()
        text = f"`{column}` {kind}"
        if isinstance(default, _Raw):
            text += f" DEFAULT {default}"
        elif default is not None:
            text += f" DEFAULT CAST({sql_literal(default)} AS {kind})"
        if comment:
            text += f" COMMENT {sql_literal(comment)}"
        listed.append(text)
    return ", ".join(listed)


def _partition(columns: Sequence[str], values: Sequence) -> str:
    pairs = [f"`{c}` = {sql_literal(v)}" for c, v in zip(columns, values, strict=True)]
    return f"PARTITION ({', '.join(pairs)})"


def _counting(df: DataFrame):
    """The frame, and a function for its row count once it has been written. Counted in the
    writing tasks themselves, each of which counts once even if it is retried."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    return counted, lambda: seen.get["n"]
