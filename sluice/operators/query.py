"""A small builder of queries in clause order, over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINS = {"INNER": "inner", "LEFT INNER": "inner", "RIGHT INNER": "inner", "LEFT": "left", "LEFT OUTER": "left", "RIGHT": "right", "RIGHT OUTER": "right", "FULL": "full", "FULL OUTER": "full", "CROSS": "cross"}


def _column(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def not_in(df: DataFrame, column: Column, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is NOT IN the first column of ``keys``, with nulls as SQL has them.

    Spark plans NOT IN by sending all keys to every task. Here two numbers about the keys come first, then a plain anti join, which can be
    a sort-merge join: no keys keep every row; a null among them keeps none; else a null in ``column`` drops its row.
    """
    named = keys.toDF(*(f"key_{k}" for k in range(len(keys.columns)))).select("key_0")
    size = named.agg(F.count("*").alias("n"), F.count("key_0").alias("known"))
    n, known = size.select("n").scalar(), size.select("known").scalar()
    return df.where((n == 0) | ((n == known) & column.isNotNull())).join(named, column == named["key_0"], "left_anti")


def join_any(left: DataFrame, right: DataFrame, conditions: list[Column]) -> DataFrame:
    """Inner join on any of some equalities: an equi-join for each, without the pairs that an earlier one has found."""
    out, earlier = None, None
    for c in conditions:
        part = left.join(right, c)
        part = part if earlier is None else part.where(~F.coalesce(earlier, F.lit(False)))
        out = part if out is None else out.union(part)
        earlier = c if earlier is None else F.coalesce(earlier, F.lit(False)) | F.coalesce(c, F.lit(False))
    return out


@dataclass(frozen=True)
class Select:
    """FROM, JOIN, WHERE, GROUP BY, HAVING, ORDER BY, LIMIT and OFFSET; nothing runs before ``df`` is used."""

    source: DataFrame
    groups: tuple[Column, ...] | None = None
    havings: tuple[Column, ...] = ()
    orders: tuple[Column, ...] = ()
    count: int | None = None
    skip: int = 0

    def join(self, other: DataFrame, kind: str = "INNER", on: Column | str | None = None) -> Select:
        how = JOINS[kind.upper()]
        if how == "cross":
            if on is not None:
                raise ValueError("CROSS JOIN takes no ON")
            return replace(self, source=self.source.crossJoin(other))
        return replace(self, source=self.source.join(other, _column(on), how))

    def where(self, condition: Column | str) -> Select:
        return replace(self, source=self.source.where(condition))

    def group_by(self, *columns: Column | str) -> Select:
        return replace(self, groups=tuple(map(_column, columns)))

    def having(self, condition: Column | str) -> Select:
        return replace(self, havings=(*self.havings, _column(condition)))

    def order_by(self, *columns: Column | str) -> Select:
        return replace(self, orders=tuple(F.col(c) if isinstance(c, str) else c for c in columns))

    def limit(self, n: int, offset: int = 0) -> Select:
        return replace(self, count=n, skip=offset)

    def offset(self, n: int) -> Select:
        return replace(self, skip=n)

    def df(self, *columns: Column | str) -> DataFrame:
        """The result. HAVING may name output columns; ORDER BY may name input columns where there is no grouping."""
        items = [*map(_column, columns)]
        if self.groups is not None:
            out = self.source.groupBy(*self.groups).agg(*items) if items else self.source.groupBy(*self.groups).agg(F.count("*").alias("__n")).drop("__n")
            for h in self.havings:
                out = out.where(h)
            out = out.orderBy(*self.orders) if self.orders else out
        else:
            out = self.source.orderBy(*self.orders) if self.orders else self.source
            out = out.select(*items) if items else out
        out = out.offset(self.skip) if self.skip else out
        return out if self.count is None else out.limit(self.count)
