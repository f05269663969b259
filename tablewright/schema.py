"""Table declarations: columns, keys, defaults and the foreign-key graph between tables.

A declaration names *properties* (what queries use) and the physical *columns* behind them.
Files hold no constraints, so keys declared here are promises that `operators.checks` verifies
and that joins use to tell which side can hold a hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# Declared type code -> Spark type, for codes without parameters.
TYPE_CODES: dict[str, T.DataType] = {
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "REAL": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "CHAR": T.StringType(),
    "VARCHAR": T.StringType(),
    "NCHAR": T.StringType(),
    "NVARCHAR": T.StringType(),
    "LONGVARCHAR": T.StringType(),
    "CLOB": T.StringType(),
    "ENUM": T.StringType(),
    "BINARY": T.BinaryType(),
    "VARBINARY": T.BinaryType(),
    "LONGVARBINARY": T.BinaryType(),
    "BLOB": T.BinaryType(),
    "BIT": T.BooleanType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIME": T.StringType(),  # 'HH:mm:ss'
}

# Python type -> type code used when a column is declared by a Python type.
PYTHON_TYPES: dict[type, str] = {
    bool: "BOOLEAN",
    int: "BIGINT",
    float: "DOUBLE",
    str: "VARCHAR",
    bytes: "BLOB",
}

# An unsigned column is stored in the next wider signed type.
UNSIGNED_CODES = {
    "TINYINT": "SMALLINT",
    "SMALLINT": "INTEGER",
    "INTEGER": "BIGINT",
}

# A column may widen to a later type of the same chain, never back.
WIDENING_CHAINS = (
    ("tinyint", "smallint", "int", "bigint"),
    ("float", "double"),
)

# What happens to a child row whose parent goes or changes its key.
FK_ACTIONS = ("NO_ACTION", "CASCADE", "SET_NULL", "SET_DEFAULT")


def snake_case(prop: str) -> str:
    """Physical column name for a property that declares none: `nChars` -> `n_chars`."""
    return re.sub(r"(?<=.)([A-Z])", r"_\1", prop).lower()


def spark_type(
    declared: str | type | T.DataType,
    precision: int | None = None,
    scale: int | None = None,
    unsigned: bool = False,
) -> T.DataType:
    """Resolve a type code, a Python type, a Spark type or its DDL text to a Spark type."""
    if isinstance(declared, T.DataType):
        return declared
    if isinstance(declared, type):
        declared = PYTHON_TYPES[declared]
    code = declared.upper()
    if code in ("NUMERIC", "DECIMAL"):
        return T.DecimalType(precision or 10, scale or 0)
    if unsigned:
        if code == "BIGINT":
            return T.DecimalType(20, 0)
        code = UNSIGNED_CODES.get(code, code)
    return TYPE_CODES[code] if code in TYPE_CODES else T.DataType.fromDDL(declared)


def can_widen(found: T.DataType, declared: T.DataType) -> bool:
    """True when every value of `found` fits `declared`, so a rewrite loses nothing."""
    if found == declared:
        return True
    if isinstance(found, T.DecimalType) and isinstance(declared, T.DecimalType):
        return (
            declared.scale >= found.scale
            and declared.precision - declared.scale >= found.precision - found.scale
        )
    a, b = found.simpleString(), declared.simpleString()
    return any(
        a in chain and b in chain and chain.index(a) < chain.index(b) for chain in WIDENING_CHAINS
    )


@dataclass(frozen=True)
class Column:
    prop: str
    type: Any
    name: str = ""
    nullable: bool = True
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    unsigned: bool = False
    auto_increment: bool = False
    default: Any = field(default=None, hash=False)
    generator: Any = None
    comment: str = ""

    @property
    def column_name(self) -> str:
        return self.name or snake_case(self.prop)

    @property
    def data_type(self) -> T.DataType:
        return spark_type(self.type, self.precision, self.scale, self.unsigned)


@dataclass(frozen=True)
class ForeignKey:
    """`props` of the declaring table refer to `ref_props` of `ref_table`, position by position."""

    props: tuple[str, ...]
    ref_table: str
    ref_props: tuple[str, ...]
    name: str = ""
    required: bool = True
    on_delete: str = "NO_ACTION"
    on_update: str = "NO_ACTION"

    def __post_init__(self):
        if len(self.props) != len(self.ref_props):
            raise ValueError(f"foreign key {self.props} and {self.ref_props} differ in length")
        for action in (self.on_delete, self.on_update):
            if action not in FK_ACTIONS:
                raise ValueError(f"unknown foreign key action {action!r}")


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    unique: Mapping[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    foreign_keys: tuple[ForeignKey, ...] = ()
    partition_by: tuple[str, ...] = ()
    comment: str = ""

    def __post_init__(self):
        known = set(self.props)
        used = [*self.primary_key, *self.partition_by]
        for group in self.unique.values():
            if set(group) & set(self.primary_key) and len(group) == 1:
                raise ValueError(f"{self.name}: {group} is the primary key already")
            used += group
        for fk in self.foreign_keys:
            used += fk.props
        unknown = [p for p in used if p not in known]
        if unknown:
            raise ValueError(f"{self.name}: unknown key properties {unknown}")

    @property
    def props(self) -> list[str]:
        return [c.prop for c in self.columns]

    def column(self, prop: str) -> Column:
        for c in self.columns:
            if c.prop == prop:
                return c
        raise KeyError(f"{self.name} has no property {prop!r}")

    def is_nullable(self, prop: str) -> bool:
        return self.column(prop).nullable and prop not in self.primary_key

    @property
    def to_physical(self) -> dict[str, str]:
        return {c.prop: c.column_name for c in self.columns if c.prop != c.column_name}

    @property
    def to_property(self) -> dict[str, str]:
        return {v: k for k, v in self.to_physical.items()}

    def struct(self, physical: bool = False) -> T.StructType:
        fields = []
        for c in self.columns:
            meta = {"property": c.prop}
            if c.length is not None:
                meta["length"] = c.length
            if c.comment:
                meta["comment"] = c.comment
            fields.append(
                T.StructField(
                    c.column_name if physical else c.prop,
                    c.data_type,
                    self.is_nullable(c.prop),
                    meta,
                )
            )
        return T.StructType(fields)

    def covers_key(self, props: Iterable[str]) -> bool:
        """True when the given properties include a declared primary or unique key, so a value
        of them occurs once at most."""
        given = set(props)
        keys = [self.primary_key, *self.unique.values()]
        return any(key and set(key) <= given for key in keys)


class Catalog:
    """The declared tables and the foreign-key graph between them."""

    def __init__(self, *specs: TableSpec):
        self.specs = {s.name: s for s in specs}

    def __getitem__(self, name: str) -> TableSpec:
        try:
            return self.specs[name]
        except KeyError:
            raise KeyError(f"table {name!r} is not declared") from None

    def __contains__(self, name: str) -> bool:
        return name in self.specs

    def with_spec(self, spec: TableSpec) -> Catalog:
        return Catalog(*{**self.specs, spec.name: spec}.values())

    def children(self, parent: str) -> list[tuple[TableSpec, ForeignKey]]:
        """Tables that refer to `parent`, each with the key that does."""
        return [
            (spec, fk)
            for spec in self.specs.values()
            for fk in spec.foreign_keys
            if fk.ref_table == parent
        ]

    def relations(self, child: str, parent: str) -> list[ForeignKey]:
        return [fk for fk in self[child].foreign_keys if fk.ref_table == parent]

    def parents_first(self, names: Iterable[str] | None = None) -> list[str]:
        """Table names with each parent before its children; tables on a cycle come in
        declaration order."""
        order: list[str] = []

        def visit(name: str, path: tuple[str, ...]):
            if name in order or name in path or name not in self.specs:
                return
            for fk in self.specs[name].foreign_keys:
                visit(fk.ref_table, (*path, name))
            if name not in order:
                order.append(name)

        for name in names or self.specs:
            visit(name, ())
        wanted = set(names or self.specs)
        return [n for n in order if n in wanted]
