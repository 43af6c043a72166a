"""Ordered, typed tables on Spark SQL."""

from .functions.aggregates import Aggregate
from .functions.expr import Row
from .schema import INT, LIST, REAL, TEXT, TIME, Field, Schema
from .table import ASCENDING, DESCENDING, NULLS_AFTER, NULLS_BEFORE, Column, ColumnBuilder, Table

__all__ = ["ASCENDING", "DESCENDING", "INT", "LIST", "NULLS_AFTER", "NULLS_BEFORE", "REAL", "TEXT", "TIME", "Aggregate", "Column", "ColumnBuilder", "Field", "Row", "Schema", "Table"]
