"""Bringing a table's data in line with a changed declaration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.checks import schema_diff
from tablewright.operators.generators import default_value
from tablewright.schema import TableSpec, can_widen

# What may be done about a table that does not match its declaration.
POLICIES = ("DEFAULT", "VALIDATE", "CREATE", "UPDATE", "CREATE_DROP")


class SchemaMismatch(ValueError):
    pass


def evolve(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Add declared columns that are missing, filled with their default, and widen types.

    Columns that are not declared stay. A type that would lose values is refused; a NULL in a
    column that has become not null takes the default, and without one fails the write.
    """
    found = {f.name: f.dataType for f in df.schema}
    columns = []
    for c in spec.columns:
        default = default_value(c)
        if c.prop not in found:
            value = default
        else:
            if not can_widen(found[c.prop], c.data_type):
                raise SchemaMismatch(
                    f"{spec.name}.{c.prop}: {found[c.prop].simpleString()} does not fit "
                    f"{c.data_type.simpleString()}"
                )
            value = F.col(f"`{c.prop}`")
            if not spec.is_nullable(c.prop) and c.default is not None:
                value = F.coalesce(value, default.cast(found[c.prop]))
        if not spec.is_nullable(c.prop):
            broken = F.raise_error(F.lit(f"{spec.name}.{c.prop} must not be null"))
            value = F.coalesce(value.cast(c.data_type), broken.cast(c.data_type))
        meta = {"comment": c.comment} if c.comment else {}
        columns.append(value.cast(c.data_type).alias(c.prop, metadata=meta))
    extra = [F.col(f"`{n}`") for n in found if n not in spec.props]
    return df.select(*columns, *extra)


def validate(tables, spec: TableSpec) -> None:
    problems = schema_diff(tables.found(spec.name), spec).collect()  # a row per property at most
    if problems:
        raise SchemaMismatch(f"{spec.name}: {[tuple(p) for p in problems]}")


def ensure(tables, name: str, policy: str = "DEFAULT") -> None:
    """Bring a table in line with its declaration, by policy.

    `DEFAULT`: it must exist. `VALIDATE`: it must exist and match. `CREATE`: create it, and the
    tables it refers to, if absent. `UPDATE`: create or evolve it. `CREATE_DROP`: create it
    anew, and drop it when the workspace is closed.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    spec, store = tables.catalog[name], tables.store
    present = store.exists(name)
    if policy in ("DEFAULT", "VALIDATE"):
        if not present:
            raise SchemaMismatch(f"table {name} does not exist")
        if policy == "VALIDATE":
            validate(tables, spec)
        return
    if policy == "CREATE_DROP":
        store.drop(name)
        store.drop_at_close(name)
        present = False
    if not present:
        for fk in spec.foreign_keys:
            if fk.ref_table != name and not store.exists(fk.ref_table):
                ensure(tables, fk.ref_table, "CREATE")
        by = [spec.column(p).column_name for p in spec.partition_by]
        store.create(name, spec.struct(physical=True), by)
    elif policy == "UPDATE":
        _update(tables, spec)


def _update(tables, spec: TableSpec) -> None:
    """Evolve a table. Missing columns are added, and types widened, in the declaration alone, and old
    files are read through it, unless a default is no constant, a NULL stands where none is allowed
    any more, or the files cannot be read as the wider type: only then are the rows written anew."""
    store, found = tables.store, tables.found(spec.name)
    types = {f.name: f.dataType for f in found.schema}
    added = [c for c in spec.columns if c.prop not in types]
    wider = [c for c in spec.columns if c.prop in types and types[c.prop] != c.data_type]
    comments = {f.name: f.metadata.get("comment", "") for f in found.schema}
    noted = {c.column_name: c.comment for c in spec.columns if c.prop in types and c.comment and c.comment != comments[c.prop]}
    if noted:
        store.comment(spec.name, noted)
    if not added and not wider:
        return
    evolved = evolve(found, spec)  # refuses what does not fit
    filled = [c.prop for c in spec.columns if c.prop in types and not spec.is_nullable(c.prop)]
    plain = all(not callable(c.default) and (c.default is not None or spec.is_nullable(c.prop)) for c in added)
    plain = plain and all(_readable(types[c.prop], c.data_type) for c in wider)
    plain = plain and not (wider and store.partition_columns(spec.name))
    if plain and filled:
        nulls = found.agg(*[F.count_if(F.col(f"`{p}`").isNull()).alias(p) for p in filled]).first()
        plain = not any(nulls)
    if not plain:
        store.replace({spec.name: tables.physical(spec.name, evolved)})
        return
    if wider:
        store.widen(spec.name, {c.column_name: c.data_type for c in wider})
    if added:
        listed = [(c.column_name, c.data_type, c.default, c.comment) for c in added]
        store.add_columns(spec.name, listed)


def _readable(old: T.DataType, new: T.DataType) -> bool:
    """Whether Parquet files of one type can be read as the other."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(old, whole) and isinstance(new, whole):
        return whole.index(type(old)) <= whole.index(type(new))
    return isinstance(old, T.FloatType) and isinstance(new, T.DoubleType)


def ensure_all(tables, policy: str = "DEFAULT") -> None:
    for name in tables.catalog.parents_first():
        ensure(tables, name, policy)
