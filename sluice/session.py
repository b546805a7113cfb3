"""Session settings and table registration."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Tables of the star schema and the event log.
RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def build_session(app: str = "sluice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI SQL; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SLUICE_DRIVER_MEMORY", "8g"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, read with pushdown and column pruning left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = RELATIONAL, prefix: str = "") -> None:
    """Temporary views for SQL text; nothing is read before a query runs."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(prefix + name)
