"""Tables in the folder that all executors share, to cut lineage. Readers go through Spark, so the folder may be in any store."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. One of our own where it is unset, which only a local master can share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own()


@lru_cache(maxsize=1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sluice-")


def new_path(spark: SparkSession, label: str = "table") -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{root(spark).rstrip('/')}/sluice/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what nothing reads any more."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended already; the folder is the cluster's to clean
        pass


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def forget(df: DataFrame) -> None:
    """Delete a table of :func:`written` before the driver ends: its last reader is done."""
    remove(df.sparkSession, df._scratch)
