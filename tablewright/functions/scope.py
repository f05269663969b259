"""Name lookup: which joined table a property name belongs to."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.schema import TableSpec


@dataclass(frozen=True)
class Source:
    """One aliased table or derived frame of a query: its columns, its declaration, sets of
    columns that are known to be unique, and whether grouping made them so."""

    props: tuple[str, ...]
    spec: TableSpec | None = None
    unique: tuple[tuple[str, ...], ...] = ()
    grouped: bool = False

    def covers_key(self, props: Iterable[str]) -> bool:
        """True when a value of the properties is known to occur once at most."""
        given = list(props)
        if self.spec and self.spec.covers_key(given):
            return True
        return any(set(group) <= set(given) for group in self.unique)


@dataclass(frozen=True)
class Scope:
    """The aliases in reach of a query. The first one is the root and owns unqualified names.

    `flags`, if given, collects the subqueries of a condition as joins, see `operators.filters`.
    `enclosing` marks the scope in which a subquery's mentions of the enclosing row are built.
    """

    root: str
    sources: dict[str, Source]
    flags: list | None = None
    enclosing: bool = False

    def qualified(self, alias: str, prop: str) -> Column:
        return F.col(f"{alias}.`{prop}`")

    def split(self, name: str) -> tuple[str | None, str]:
        alias, dot, prop = name.partition(".")
        return (alias, prop) if dot else (None, name)

    def resolve(self, name: str) -> Column:
        alias, prop = self.split(name)
        if alias is None:
            owner = self.owner(prop)
            return self.qualified(owner, prop) if owner else F.col(f"`{prop}`")
        if alias in self.sources:
            return self.qualified(alias, prop)
        return self.qualified(alias, prop).outer()

    def owner(self, prop: str) -> str | None:
        """Alias an unqualified property belongs to: the root, else the first that has it."""
        if prop in self.sources[self.root].props:
            return self.root
        return next((a for a, s in self.sources.items() if prop in s.props), None)

    def spec(self, alias: str | None = None) -> TableSpec:
        spec = self.sources[alias or self.root].spec
        if spec is None:
            raise ValueError(f"{alias or self.root!r} is a derived table without declared keys")
        return spec

    def is_outer(self, name: str) -> bool:
        """Whether a name belongs to the enclosing query."""
        alias, _ = self.split(name)
        return alias is not None and alias not in self.sources

    def watched(self) -> WatchedScope:
        return WatchedScope(self.root, self.sources)


class WatchedScope(Scope):
    """A scope that notes which names were looked up, and which of them are the enclosing query's."""

    def __init__(self, root: str, sources: dict[str, Source]):
        super().__init__(root, sources)
        object.__setattr__(self, "outer_names", [])
        object.__setattr__(self, "aliases", set())

    def resolve(self, name: str) -> Column:
        alias, prop = self.split(name)
        self.aliases.add(alias or self.owner(prop) or self.root)
        if self.is_outer(name):
            self.outer_names.append(name)
        return super().resolve(name)
