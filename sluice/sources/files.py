"""Files: CSV out and in, and tables as Parquet with a JSON sidecar."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT_VERSION = 1


def write_csv(df: DataFrame, path: str) -> None:
    """Header and rows: text in double quotes, doubled inside; null is empty; decimals plain; dates ISO.

    Spark's own writer quotes all fields or those that need it, so rows are put together here and written as lines.
    """
    fields = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) if isinstance(f.dataType, T.StringType) else c.cast("string")
        fields.append(F.coalesce(text, F.lit("")))
    header, line = F.lit(",".join(df.columns)), F.concat_ws(",", *fields)
    # The header stands before the first row of each partition, which is a file.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = df.select(line.alias("line"), first.alias("first")).select(F.explode(F.when(F.col("first"), F.array(header, "line")).otherwise(F.array("line"))).alias("value"))
    if df.isEmpty():
        lines = df.sparkSession.range(1).select(header.alias("value"))
    lines.write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = True) -> DataFrame:
    """Rows of :func:`write_csv`, with a declared schema; an empty field is null, two quotes are empty text.

    ``line_breaks``: whether texts may hold line breaks; where none does, large files are read in parts. The parser gives an empty field the null mark, which no text holds, so the two stay apart.
    """
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "\x01").option("emptyValue", "").option("multiLine", line_breaks).csv(path)


def write_table(df: DataFrame, path: str, meta: dict) -> None:
    """Parquet rows, and their metadata with a format version beside them."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/rows")
    text = json.dumps({"version": FORMAT_VERSION, "schema": df.schema.jsonValue(), **meta})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/meta").collect()))
    if meta["version"] != FORMAT_VERSION:
        raise ValueError(f"{path} has format {meta['version']}, not {FORMAT_VERSION}")
    return spark.read.schema(T.StructType.fromJson(meta["schema"])).parquet(f"{path}/rows"), meta
