"""A planned change of one or more tables: the new contents, and the rows it affects.

Files are not updated in place. A change is a pure function of the tables it reads, and
`Workspace.apply` writes and switches to the result, unless a table it changes has moved on since.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TableChange:
    """New contents, affected old rows, and the properties that get other values (none for a
    delete). A table partitioned by other properties is rewritten in the affected rows'
    partitions only. `marked`, if given, is the new contents with a column that is true for affected
    rows, so that the job that writes them counts them."""

    frame: DataFrame
    affected: DataFrame
    changed: frozenset[str] = frozenset()
    marked: DataFrame | None = None


@dataclass(frozen=True)
class Change:
    parts: dict[str, TableChange] = field(default_factory=dict)
    versions: dict[str, str | None] = field(default_factory=dict)  # of the tables as planned

    def frame(self, table: str) -> DataFrame:
        return self.parts[table].frame

    def affected(self, table: str) -> DataFrame:
        return self.parts[table].affected


def planned(tables, parts: dict[str, TableChange]) -> Change:
    """A change with the versions that its tables had when they were last read, for this plan."""
    return Change(parts, {name: tables.versions[name] for name in parts if name in tables.versions})
