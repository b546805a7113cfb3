"""Helpers shared by the operators of this subpackage.

Tables are read with Spark's reader only (inputs may live in a store that Python cannot open), and
intermediate tables go to the shared folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import os
import re
import unicodedata
from pathlib import Path
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.scratch import forget, new_path as scratch_path, written  # noqa: F401  the shared folder's tables

# A task has one core: the tokenizers library's threads would only wait for one another there.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Rows handed to a Python worker at once are regrouped into chunks of about this many characters.
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_text(col: Column) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(col.cast("string").cast("binary"))


def map_arrow(df: DataFrame, columns: list[Column], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches of ``columns``; one batch in, at most one batch out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.select(*columns).mapInArrow(run, schema)


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``CHUNK_CHARS`` bytes, so very long texts do not pile up."""
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, CHUNK_CHARS // per_row)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def texts(column: pa.Array) -> list[str]:
    """The texts of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Numpy's products use one thread in this process: a task has one core, and threads that wait for another would only take time."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def narrow(text: str) -> bool:
    """Whether all characters are below U+0100."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class LetterRuns:
    """Runs of letters, by Unicode category: numbers that are no decimal digits, as fractions and Roman numerals, are none.

    Python counts those numbers as word characters, so each is first replaced by a space, which keeps all offsets. One class that leaves them
    out would be tried sign by sign, which takes some twenty times as long.
    """

    def __init__(self) -> None:
        self._numbers = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L")
        self._runs = re.compile(r"[^\W\d_]+")

    def _plain(self, text: str) -> str:
        for number in () if text.isascii() else self._numbers.intersection(text):
            text = text.replace(number, " ")
        return text

    def findall(self, text: str) -> list[str]:
        return self._runs.findall(self._plain(text))

    def finditer(self, text: str) -> Iterator[re.Match]:
        return self._runs.finditer(self._plain(text))

    def search(self, text: str) -> re.Match | None:
        return self._runs.search(self._plain(text))


@lru_cache(maxsize=1)
def letter_runs() -> LetterRuns:
    """The finder of letter runs; one for each process."""
    return LetterRuns()


#: A key of more rows than this is joined by broadcast; at most HUBS keys are, so the bound grows with the rows beyond that.
HUB_ROWS, HUBS = 10_000, 1_000_000


def hub_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, hub_rows: int = HUB_ROWS) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key``, where some keys may have a large part of ``left``'s rows.

    Rows of such keys are not moved: there are at most HUBS of these keys, and ``right``'s rows for them go to every task. ``counts``
    (``key``, ``n``) tells how often keys come in ``left``, if that is known more cheaply. The same with or without adaptive execution.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    counts = written(counts.where(F.col("n") > hub_rows), "hub-counts")
    seen = counts.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    if not seen["keys"]:
        return left.join(right, key)
    hubs = counts.where(F.col("n") > seen.rows // HUBS).select(key)
    found = written(right.join(F.broadcast(hubs), key), "hubs")
    cold = left.join(F.broadcast(hubs), key, "left_anti").join(right, key)
    return cold.unionByName(left.join(F.broadcast(found), key))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
