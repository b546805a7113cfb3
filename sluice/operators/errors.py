"""Errors by what went wrong; each is also the built-in error that fits it best."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException


class EngineError(RuntimeError):
    """Any error of the engine; ``str`` tells what is wrong and where."""


class StatementError(EngineError, ValueError):
    """A statement that cannot be read."""


class TableNotFoundError(EngineError, KeyError):
    """A table that does not exist."""

    def __str__(self) -> str:
        return RuntimeError.__str__(self)


class ColumnNotFoundError(EngineError, ValueError):
    """A column that does not exist, or of which there are several."""


class ConstraintError(EngineError, ValueError):
    """A change that a constraint forbids; the table is as before."""


class MaxRowsError(EngineError):
    """A result has more rows than the limit allows."""


class TransactionError(EngineError):
    """A transaction was ended without being begun, or begun twice."""


@contextmanager
def translated():
    """Errors of Spark's parser and analyser as errors of the engine."""
    try:
        yield
    except ParseException as e:
        raise StatementError(str(e)) from e
    except AnalysisException as e:
        kind = e.getCondition() or ""
        if kind.startswith("TABLE_OR_VIEW_NOT_FOUND"):
            raise TableNotFoundError(str(e)) from e
        if kind.startswith(("UNRESOLVED_COLUMN", "AMBIGUOUS_REFERENCE", "MISSING_AGGREGATION")):
            raise ColumnNotFoundError(str(e)) from e
        raise StatementError(str(e)) from e
