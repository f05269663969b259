"""Declared tables, composable queries and table changes on PySpark DataFrames."""

from tablewright.schema import Catalog, Column, ForeignKey, TableSpec
from tablewright.workspace import Workspace

__all__ = ["Catalog", "Column", "ForeignKey", "TableSpec", "Workspace"]
