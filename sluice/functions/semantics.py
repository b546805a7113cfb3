"""Documented departures from standard results, each by choice only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sum_as(column: Column, kind: T.DataType) -> Column:
    """SUM in the column's own type, not a wider one."""
    return F.sum(column).cast(kind)


def avg_as(column: Column, kind: T.DataType) -> Column:
    """AVG in the column's own type: that of integers is truncated."""
    if isinstance(kind, T.IntegralType):
        return (F.sum(column.cast("decimal(38,0)")) / F.count(column)).cast(kind)
    return F.avg(column).cast(kind)


def first_of_group(column: str, order: str) -> Column:
    """A column that is not grouped: its value in the group's first row by ``order``."""
    return F.min_by(column, order)


def nearly_equal(a: Column, b: Column, within: float = 1e-7) -> Column:
    """Equality of floating-point numbers within a tolerance."""
    return F.abs(a - b) < within


def in_ignoring_nulls(column: Column, values: list) -> Column:
    """IN over a list whose nulls do not count, so NOT IN can be true."""
    return column.isin([v for v in values if v is not None])


def first_cell(column: str, order: str) -> Column:
    """Of a subquery with more than one row, the value in its first one."""
    return F.min_by(column, order)
