"""Tables that can be changed: a DataFrame with constraints and sequences, rewritten by each change.

A change makes a new DataFrame and leaves the old one as it is, so snapshots cost nothing. After ``CUT`` changes the rows are
written to the shared folder, which keeps plans short.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.types import coerce, spark_type, valid
from sluice.operators.errors import ColumnNotFoundError, ConstraintError
from sluice.sources.scratch import written

CUT = 12


@dataclass(frozen=True)
class Sequence:
    """A sequence of a key column; ``next`` is the number it gives out next."""

    name: str
    column: str
    next: int
    step: int


@dataclass(frozen=True)
class Table:
    """Rows and what is declared of them. Changes return a new table."""

    name: str
    df: DataFrame
    sql_types: dict[str, str] = field(default_factory=dict)
    primary_key: str | None = None
    unique: tuple[str, ...] = ()
    sequences: tuple[Sequence, ...] = ()
    indexes: tuple[tuple[str, str], ...] = ()
    changes: int = 0

    @classmethod
    def create(cls, spark: SparkSession, name: str, columns: dict[str, str], primary_key: str | None = None, sequences: tuple[Sequence, ...] = ()) -> Table:
        schema = T.StructType([T.StructField(c, spark_type(t)) for c, t in columns.items()])
        return cls(name, spark.createDataFrame([], schema), {c: t.strip().upper() for c, t in columns.items()}, primary_key, (), sequences)

    @property
    def keys(self) -> list[str]:
        """Columns whose values must differ."""
        return list(dict.fromkeys([*([self.primary_key] if self.primary_key else []), *self.unique]))

    def _changed(self, df: DataFrame, **more) -> Table:
        if self.changes + 1 >= CUT:
            return replace(self, df=written(df), changes=0, **more)
        return replace(self, df=df, changes=self.changes + 1, **more)

    def _column(self, name: str) -> str:
        for c in self.df.columns:
            if c.lower() == name.lower().strip('"`'):
                return c
        raise ColumnNotFoundError(f"table {self.name} has no column {name}")

    def insert(self, columns: list[str], values: list[object]) -> Table:
        """One row. All columns but those of sequences must be given, and those must not."""
        given = {self._column(c): v for c, v in zip(columns, values, strict=True)}
        by_column = {s.column: s for s in self.sequences}
        if wrong := by_column.keys() & given.keys():
            raise ConstraintError(f"{', '.join(sorted(wrong))}: numbered by a sequence")
        if lacking := [c for c in self.df.columns if c not in given and c not in by_column]:
            raise ConstraintError(f"no value for {', '.join(lacking)}")
        row = [by_column[c].next if c in by_column else coerce(given[c], self.sql_types.get(c, "STRING")) if c in self.sql_types else given[c] for c in self.df.columns]
        if self.primary_key and row[self.df.columns.index(self.primary_key)] is None:
            raise ConstraintError(f"{self.primary_key} is null")
        tests = [F.col(f"`{k}`") == F.lit(v).cast(self.df.schema[k].dataType) for k in self.keys if (v := row[self.df.columns.index(k)]) is not None and k not in by_column]
        if tests:
            clash = tests[0]
            for t in tests[1:]:
                clash |= t
            if not self.df.where(clash).isEmpty():
                raise ConstraintError(f"duplicate key in {self.name}")
        new = self.df.sparkSession.createDataFrame([tuple(row)], self.df.schema)
        return self._changed(self.df.unionByName(new), sequences=tuple(replace(s, next=s.next + s.step) for s in self.sequences))

    def bulk_insert(self, rows: DataFrame) -> Table:
        """Many rows at once, or none of them if any fails a check. Sequence columns are numbered."""
        for s in self.sequences:
            rows = number_rows(rows.drop(s.column), s.column, s.next, s.step, [c for c in rows.columns if c != s.column])
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.df.schema.fields))
        bad = ~F.lit(True)
        for c, t in self.sql_types.items():
            bad |= ~valid(F.col(f"`{c}`"), t)
        if not rows.where(bad).isEmpty():
            raise ConstraintError(f"a value breaks its type in {self.name}")
        whole = self.df.unionByName(rows)
        self.check(whole)
        steps = {s.name: rows.count() * s.step for s in self.sequences}
        return self._changed(whole, sequences=tuple(replace(s, next=s.next + steps[s.name]) for s in self.sequences))

    def check(self, df: DataFrame) -> None:
        """Keys of ``df`` differ, and the primary key is not null: one aggregation for each key."""
        if self.primary_key and not df.where(F.col(f"`{self.primary_key}`").isNull()).isEmpty():
            raise ConstraintError(f"{self.primary_key} is null")
        for k in self.keys:
            if not df.where(F.col(f"`{k}`").isNotNull()).groupBy(f"`{k}`").agg(F.count("*").alias("__count")).where("__count > 1").isEmpty():
                raise ConstraintError(f"duplicate {k} in {self.name}")

    def update(self, changes: dict[str, object], where: Column | str | None = None) -> Table:
        """Literals for columns, in the rows where the condition is true; unknown changes nothing."""
        condition = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
        new = {self._column(c): v if isinstance(v, Column) else F.lit(coerce(v, self.sql_types[self._column(c)]) if self._column(c) in self.sql_types else v) for c, v in changes.items()}
        out = self.df.select(*(F.when(condition, new[f.name].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in new else F.col(f"`{f.name}`") for f in self.df.schema.fields))
        if set(new) & set(self.keys):
            self.check(out)
        return self._changed(out)

    def delete(self, where: Column | str | None = None) -> Table:
        """Without the rows where the condition is true; unknown keeps a row."""
        if where is None:
            return self._changed(self.df.limit(0))
        condition = F.expr(where) if isinstance(where, str) else where
        return self._changed(self.df.where(~F.coalesce(condition, F.lit(False))))

    def delete_in(self, column: str, keys: DataFrame) -> Table:
        """Without the rows whose column is in the first column of ``keys``."""
        named = keys.toDF("__key", *keys.columns[1:]).select("__key")
        return self._changed(self.df.join(named, F.col(f"`{self._column(column)}`") == named["__key"], "left_anti"))

    def create_index(self, column: str, kind: str = "INDEX") -> Table:
        """Record an index. Spark needs none for speed; UNIQUE ones are checked now and from now on."""
        c = self._column(column)
        out = replace(self, indexes=(*self.indexes, (kind.upper(), c)), unique=(*self.unique, c) if "UNIQUE" in kind.upper() else self.unique)
        out.check(self.df)
        return out

    def meta(self) -> dict:
        return {"name": self.name, "sql_types": self.sql_types, "primary_key": self.primary_key, "unique": list(self.unique), "sequences": [vars(s) for s in self.sequences], "indexes": [list(i) for i in self.indexes]}

    @classmethod
    def from_meta(cls, df: DataFrame, meta: dict) -> Table:
        return cls(meta["name"], df, meta["sql_types"], meta["primary_key"], tuple(meta["unique"]), tuple(Sequence(**s) for s in meta["sequences"]), tuple(map(tuple, meta["indexes"])))


def number_rows(df: DataFrame, column: str, start: int, step: int, order: list[str]) -> DataFrame:
    """Gap-free numbers in the order of ``order``, without bringing the rows together.

    Rows are dealt out by ranges; one count for each range goes to the driver, and rows are numbered within their range.
    """
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["__n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("__n")).collect()}
    base, at = [], 0
    for part in sorted(counts):
        base.append((part, at))
        at += counts[part]
    from pyspark.sql.window import Window

    row = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    bases = df.sparkSession.createDataFrame(base, "__part int, __base long")
    return ranged.withColumn("__row", row).join(F.broadcast(bases), "__part").withColumn(column, F.lit(start) + (F.col("__base") + F.col("__row")) * step).drop("__part", "__row", "__base")
