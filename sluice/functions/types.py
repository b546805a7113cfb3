"""Column types by their SQL names, and the checks a value passes before it is stored."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits after the point of a decimal that is declared without a scale.
DEFAULT_SCALE = 10

TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(),
    "INTEGER": T.IntegerType(),
    "LONG": T.LongType(),
    "SHORT": T.ShortType(),
    "BYTE": T.ByteType(),
    "BIGDECIMAL": T.DecimalType(38, DEFAULT_SCALE),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "CHAR": T.StringType(),
    "UUID": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "DATETIME_MS": T.TimestampNTZType(),
}
RANGES = {"BYTE": 8, "SHORT": 16, "INTEGER": 32, "LONG": 64}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a SQL type name; ``BIGDECIMAL(p, s)`` declares precision and scale."""
    name = name.strip().upper()
    if m := re.fullmatch(r"BIGDECIMAL\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    if name not in TYPES:
        raise ValueError(f"unsupported column type {name}")
    return TYPES[name]


def valid(column: Column, name: str) -> Column:
    """Whether a stored column keeps the rules of a SQL type that Spark's own type does not state; null does."""
    if name == "CHAR":
        ok = F.length(column) == 1
    elif name == "UUID":
        ok = column.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    elif name in ("FLOAT", "DOUBLE"):
        ok = ~F.isnan(column) & (F.abs(column) != float("inf"))
    else:
        ok = F.lit(True)
    return column.isNull() | ok


def coerce(value: object, name: str) -> object:
    """A Python value for a column of SQL type ``name``; text is read, and what does not fit is refused."""
    if value is None:
        return None
    base = name.split("(")[0].strip().upper()
    try:
        if base in RANGES:
            if isinstance(value, bool) or isinstance(value, (float, decimal.Decimal)) and value != int(value):
                raise ValueError
            n = int(value)
            if not -(1 << RANGES[base] - 1) <= n < 1 << RANGES[base] - 1:
                raise ValueError
            return n
        if base == "BIGDECIMAL":
            return decimal.Decimal(str(value))
        if base in ("FLOAT", "DOUBLE"):
            x = float(value)
            if not math.isfinite(x):
                raise ValueError
            return x
        if base == "BOOLEAN":
            if isinstance(value, bool):
                return value
            return {"TRUE": True, "FALSE": False}[str(value).upper()]
        if base == "CHAR":
            if len(str(value)) != 1:
                raise ValueError
            return str(value)
        if base == "UUID":
            if len(str(value)) != 36:
                raise ValueError
            return str(uuid.UUID(str(value)))
        if base == "DATE":
            return value if isinstance(value, dt.date) and not isinstance(value, dt.datetime) else dt.date.fromisoformat(str(value))
        if base in ("DATETIME", "DATETIME_MS"):
            return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
        return str(value)
    except (ValueError, KeyError, decimal.InvalidOperation) as e:
        raise ValueError(f"{value!r} is no {name}") from e
