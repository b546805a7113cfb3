"""A prompt for statements: ``python -m sluice [folder of tables]``. Statements end with a semicolon; ``quit`` ends."""

from __future__ import annotations

import os
import sys

from sluice.operators.database import Database
from sluice.operators.errors import EngineError
from sluice.session import build_session, load


def statements(lines):
    """Text up to each semicolon that ends a line."""
    held = ""
    for line in lines:
        if not held and line.strip().lower() in ("quit", "exit"):
            return
        held += line
        if held.rstrip().endswith(";"):
            yield held.strip().rstrip(";")
            held = ""
    if held.strip():
        yield held.strip()


def run(db: Database, lines, rows: int = 20, show=print) -> None:
    """Execute statements and show their results; an error ends its statement only."""
    for sql in statements(lines):
        try:
            got = db.execute(sql)
        except EngineError as e:
            show(f"{type(e).__name__}: {str(e).splitlines()[0]}")
            continue
        if isinstance(got, str):
            show(got)
        else:
            show(" | ".join(got.columns))
            for row in got.take(rows):
                show(" | ".join("NULL" if v is None else str(v) for v in row))


def main(folder: str | None = None) -> None:
    spark = build_session("prompt", "local[*]", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    db = Database(spark, slow_seconds=1.0)
    for name in sorted(os.listdir(folder)) if folder else ():
        if name.endswith(".parquet"):
            db.register(name.removesuffix(".parquet"), load(spark, folder, name.removesuffix(".parquet")))
    run(db, sys.stdin)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:2])
